"""speechmart.sources"""
