"""postingscope.plans"""
