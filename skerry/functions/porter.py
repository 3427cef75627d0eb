"""Porter's stemmer as SQL, step by step, meant for a vocabulary rather than for every token.

The measure conditions of the algorithm are regular once a consonant y is written Y, so each rule is a
suffix, what replaces it, and a pattern for the rest of the word. The same text runs in other engines
that have LIKE, substr and regular expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_C, _V = "[^aeiouy]", "[aeiouy]"
M0 = f"^{_C}*{_V}+{_C}"
M1 = f"^{_C}*{_V}+{_C}+{_V}+{_C}"
ONE = f"^{_C}*{_V}+{_C}+{_V}*$"
CVC = f"{_C}{_V}[^aeiouywxY]$"

# Suffixes and their replacements in steps 2 to 4 of the algorithm, with its two published departures.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def steps(match: str) -> list[str]:
    """Expressions over ``w``, to be applied in turn. ``match``: a template of a test of ``{0}`` against ``{1}``."""
    test = lambda e, p: match.format(e, p)
    cut = lambda k: f"substr(w, 1, length(w) - {k})"

    def table(rules: dict[str, str], pat: str, extra: dict[str, str] | None = None) -> str:
        out = "CASE"
        for suf in sorted(rules, key=lambda s: (-len(s), s)):
            ok = test(cut(len(suf)), pat)
            if extra and suf in extra:
                ok += " AND " + test(cut(len(suf)), extra[suf])
            out += f" WHEN w LIKE '%{suf}' THEN CASE WHEN {ok} THEN concat({cut(len(suf))}, '{rules[suf]}') ELSE w END"
        return out + " ELSE w END"

    ed = "CASE WHEN w LIKE '%eed' THEN CASE WHEN {0} THEN concat({1}, 'ee') ELSE w END WHEN w LIKE '%ed' AND {2} THEN concat({3}, '|') WHEN w LIKE '%ing' AND {4} THEN concat({5}, '|') ELSE w END".format(
        test(cut(3), M0), cut(3), test(cut(2), _V), cut(2), test(cut(3), _V), cut(3)
    )
    double = f"substr(w, -2, 1) = substr(w, -3, 1) AND {test(cut(1), '[^aeiouylsz]$')}"
    return [
        "CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN substr(w, 1, length(w) - 2) WHEN w LIKE '%s' AND NOT w LIKE '%ss' THEN substr(w, 1, length(w) - 1) ELSE w END",
        ed,
        f"CASE WHEN NOT w LIKE '%|' THEN w WHEN w LIKE '%at|' OR w LIKE '%bl|' OR w LIKE '%iz|' THEN concat({cut(1)}, 'e') WHEN {double} THEN {cut(2)} WHEN {test(cut(1), ONE)} AND {test(cut(1), CVC)} THEN concat({cut(1)}, 'e') ELSE {cut(1)} END",
        f"CASE WHEN (w LIKE '%y' OR w LIKE '%Y') AND {test(cut(1), _V)} THEN concat({cut(1)}, 'i') ELSE w END",
        table(STEP2, M0),
        table(STEP3, M0),
        table(dict.fromkeys(STEP4, ""), M1, {"ion": "[st]$"}),
        f"CASE WHEN w LIKE '%e' AND ({test(cut(1), M1)} OR ({test(cut(1), ONE)} AND NOT {test(cut(1), CVC)})) THEN {cut(1)} ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {test(cut(1), M1)} THEN {cut(1)} ELSE w END",
        "replace(w, 'Y', 'y')",
    ]


def stems(vocabulary: DataFrame, col: str = "term") -> DataFrame:
    """``term, stem`` of distinct terms; terms of up to two characters stay."""
    w = F.regexp_replace(F.regexp_replace(col, "^y", "Y"), "([aeiou])y", "$1Y")
    df = vocabulary.select(col).distinct().withColumn("w", w)
    for e in steps("({0} RLIKE '{1}')"):
        df = df.withColumn("w", F.expr(e))
    return df.select(col, F.when(F.length(col) > 2, F.col("w")).otherwise(F.col(col)).alias("stem"))
