"""talentscope.sources"""
