"""speechmart.operators"""
