"""webkb.operators"""
