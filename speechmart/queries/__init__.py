"""speechmart.queries"""
