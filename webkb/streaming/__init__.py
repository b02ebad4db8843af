"""webkb.streaming"""
