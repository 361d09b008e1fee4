"""talentscope.operators"""
