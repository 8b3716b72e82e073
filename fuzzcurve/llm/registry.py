"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, chosenpath, decontaminate, jaccard, language, packing, periods, quality, repair, substring, suffix, urls

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_urls": urls.op3_urls,
    "op4_bpe": bpe.op4_bpe,
    "op5_language": language.op5_language,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_chat": chat.op7_chat,
    "op8_suffix": suffix.op8_suffix,
    "op9_substring": substring.op9_substring,
    "op10_packing": packing.op10_packing,
    "op11_repair": repair.op11_repair,
    "op12_periods": periods.op12_periods,
    "op13_chosenpath": chosenpath.op13_chosenpath,
}
ORACLES = {
    "op1_quality": quality.ORACLE,
    "op2_jaccard": jaccard.ORACLE,
    "op3_urls": urls.ORACLE,
    "op9_substring": substring.ORACLE,
    "op12_periods": periods.ORACLE,
    "op13_chosenpath": chosenpath.ORACLE,
}
