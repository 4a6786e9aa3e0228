"""Packet scaling used before and after quantisation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowloom import constants as K

# What counts as a zero gap when scaling and when scaling back.
ZERO_IPT = 1e-8
ZERO_SCALED_IPT = 1e-3


def scaled_ps(ps: Column, max_size: int = K.MAX_PACKET_SIZE) -> Column:
    return ps / F.lit(float(max_size))


def scaled_ipt(ipt: Column) -> Column:
    return F.when(F.abs(ipt) <= ZERO_IPT, F.lit(0.0)).otherwise(F.log10(ipt))


def unscaled_ps(ps: Column, max_size: int = K.MAX_PACKET_SIZE) -> Column:
    return ps * F.lit(float(max_size))


def unscaled_ipt(ipt: Column) -> Column:
    return F.when(F.abs(ipt) <= ZERO_SCALED_IPT, F.lit(0.0)).otherwise(F.pow(F.lit(10.0), ipt))
