from evenkeel.functions.scalar import *  # noqa: F401,F403
