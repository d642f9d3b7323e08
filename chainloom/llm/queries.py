"""Queries of the training-data operators for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chainloom.llm.bpe import op5_bpe
from chainloom.llm.html import op4_html
from chainloom.llm.lm import op7_lm
from chainloom.llm.media import op8_media
from chainloom.llm.neardup import op10_neardup
from chainloom.llm.packing import op6_packing
from chainloom.llm.suffix import op3_suffix
from chainloom.llm.topk import OP2_SQL, op2_topk
from chainloom.llm.toxicity import op1_toxicity
from chainloom.llm.urls import op9_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_topk": op2_topk,
    "op3_suffix": op3_suffix,
    "op4_html": op4_html,
    "op5_bpe": op5_bpe,
    "op6_packing": op6_packing,
    "op7_lm": op7_lm,
    "op8_media": op8_media,
    "op9_urls": op9_urls,
    "op10_neardup": op10_neardup,
}

#: The others can't be stated in SQL; tests hold them against brute force, round trips and held-out labels.
ORACLES: dict[str, str] = {"op2_topk": OP2_SQL}
