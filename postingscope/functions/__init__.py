"""postingscope.functions"""
