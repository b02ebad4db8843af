"""webkb.functions"""
