"""speechmart.streaming"""
