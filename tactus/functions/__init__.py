"""tactus.functions"""
