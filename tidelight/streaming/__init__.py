"""tidelight.streaming"""
