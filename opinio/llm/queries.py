"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from ..session import ship_package
from . import contentsort, convrepair, decontamination, langid, linededup, lmscore, mixing, pii, quality, simhash, suffixdedup, veccode, warc

_OPS = {
    "op1_lmscore": (lmscore.op1_lmscore, lmscore.ORACLE_SQL),
    "op2_decontamination": (decontamination.op2_decontamination, decontamination.ORACLE_SQL),
    "op3_quality": (quality.op3_quality, None),
    "op4_langid": (langid.op4_langid, None),
    "op5_warc": (warc.op5_warc, warc.ORACLE_SQL),
    "op6_linededup": (linededup.op6_linededup, None),
    "op7_pii": (pii.op7_pii, pii.ORACLE_SQL),
    "op8_suffixdedup": (suffixdedup.op8_suffixdedup, None),
    "op9_mixing": (mixing.op9_mixing, mixing.ORACLE_SQL),
    "op10_simhash": (simhash.op10_simhash, None),
    "op11_vectorcodes": (veccode.op11_vectorcodes, veccode.ORACLE_SQL),
    "op12_convrepair": (convrepair.op12_convrepair, convrepair.ORACLE_SQL),
    "op13_exactdedup": (contentsort.op13_exactdedup, contentsort.ORACLE_SQL),
}


def _query(fn):
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


def queries() -> dict:
    return {name: _query(fn) for name, (fn, _) in _OPS.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _OPS.items() if sql}
