"""lodeline.plans"""
