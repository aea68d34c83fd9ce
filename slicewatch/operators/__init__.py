"""DataFrame → DataFrame operators of the detection → recovery chain."""
