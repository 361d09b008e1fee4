"""talentscope.functions"""
