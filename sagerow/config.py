"""Frozen constants of the data model.

The special-token strings and ids below are fixed values: they must equal
the ones the task files and vocabularies were built with, or extraction,
layout and decoding stop matching.
"""

from __future__ import annotations

from dataclasses import dataclass


# ---- fixed values (special tokens and their ids) ------------------------
EOS_TOKEN = "<|endoftext_R9VQqF0Ag7|>"
PAD_TOKEN = "ÃÂ" * 16
SEP_TOKEN = "-" * 64
EOS_ID = 0
SEP_ID = 32021
PAD_ID = 25670
IGNORE_INDEX = -100
GENERATED_TASK_ID_START = 8000
# ---- end of fixed values -------------------------------------------------


@dataclass(frozen=True)
class Tokens:
    """Special tokens; ids depend on the vocabulary in use."""

    eos: str = EOS_TOKEN
    pad: str = PAD_TOKEN
    sep: str = SEP_TOKEN
    eos_id: int = EOS_ID
    sep_id: int = SEP_ID
    pad_id: int = PAD_ID
    ignore_index: int = IGNORE_INDEX


DEFAULT_TOKENS = Tokens()
