"""reelspark.functions"""
