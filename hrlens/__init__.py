"""hrlens"""
