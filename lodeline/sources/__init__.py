"""lodeline.sources"""
