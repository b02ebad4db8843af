"""webkb.sources"""
