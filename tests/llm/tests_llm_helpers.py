"""Plain versions shared by the tests of operators and pipeline."""

from test_lines import plain as plain_spans  # noqa: F401
from test_mixing import plain as plain_mix  # noqa: F401
from test_neardup import plain as plain_components  # noqa: F401
