"""reelspark.sources"""
