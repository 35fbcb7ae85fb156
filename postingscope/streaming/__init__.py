"""postingscope.streaming"""
