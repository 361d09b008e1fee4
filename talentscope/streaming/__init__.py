"""talentscope.streaming"""
