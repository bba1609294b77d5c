"""Column functions: time, bytes, text."""
from .bytescols import *  # noqa: F401,F403
from .textcols import *  # noqa: F401,F403
from .timecols import *  # noqa: F401,F403
