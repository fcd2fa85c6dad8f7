"""tactus.plans"""
