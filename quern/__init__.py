"""quern"""
