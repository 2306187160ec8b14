"""speechmart.functions"""
