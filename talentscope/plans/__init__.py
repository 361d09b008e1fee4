"""talentscope.plans"""
