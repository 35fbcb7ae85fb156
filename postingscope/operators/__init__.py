"""postingscope.operators"""
