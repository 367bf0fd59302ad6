"""tidelight.plans"""
