"""postingscope.sources"""
