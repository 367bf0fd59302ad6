"""tidelight.operators"""
