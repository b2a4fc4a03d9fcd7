"""reelspark.plans"""
