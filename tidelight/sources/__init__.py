"""tidelight.sources"""
