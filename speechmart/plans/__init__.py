"""speechmart.plans"""
