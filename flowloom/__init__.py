"""Network-flow analytics on Spark DataFrames.

Packets are assembled into bidirectional flows, summarised, labelled, tokenised,
modelled, classified and compared; every operator maps DataFrames to DataFrames.
"""
