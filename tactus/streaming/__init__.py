"""tactus.streaming"""
