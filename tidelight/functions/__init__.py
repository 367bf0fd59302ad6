"""tidelight.functions"""
