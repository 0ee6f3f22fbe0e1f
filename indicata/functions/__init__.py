from indicata.functions.scalars import *  # noqa: F401,F403
from indicata.functions.scalars import __all__  # noqa: F401
