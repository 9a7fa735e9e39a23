from grovecount.functions.image import (  # noqa: F401
    clamp,
    direction_bin,
    gray_of,
    radius_max,
    radius_min,
)
from grovecount.functions.text import (  # noqa: F401
    ends_with,
    ends_with_any,
    file_name,
    prefix_before,
    render_pair,
    split_lines,
)
