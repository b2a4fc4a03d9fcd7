"""reelspark.operators"""
