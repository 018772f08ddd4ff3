"""lodestone.plans"""
