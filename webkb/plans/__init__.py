"""webkb.plans"""
