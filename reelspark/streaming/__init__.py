"""reelspark.streaming"""
