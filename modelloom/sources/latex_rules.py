"""Authors' LaTeX to the canonical spelling: an ordered table of rewrites, on columns or, with the place of each, on one text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from modelloom.sources import latex

# The rules in order, each with its name, its pattern and what takes its place (<1> and <2> are groups).
RULES = (
    ("u2264_le", "\u2264", r"\le"),
    ("u2265_ge", "\u2265", r"\ge"),
    ("u2260_neq", "\u2260", r"\neq"),
    ("u2200_forall", "\u2200", r"\forall"),
    ("u2208_in", "\u2208", r"\in"),
    ("u00d7_cdot", "\u00d7", r"\cdot"),
    ("u22c5_cdot", "\u22c5", r"\cdot"),
    ("u2212_minus", "\u2212", "-"),
    ("u2211_sum", "\u2211", r"\sum"),
    ("ascii_le", r"<=", r"\le"),
    ("ascii_ge", r">=", r"\ge"),
    ("ascii_ne", r"!=", r"\neq"),
    ("ascii_eqeq", r"==", "="),
    ("star_cdot", r"\s*\*\s*", r" \cdot "),
    ("mathbb_mathcal", r"\\mathbb\s*\{([A-Za-z][\w\\]*)\}", r"\mathcal{<1>}"),
    ("mathrm_set_mathcal", r"\\mathrm\s*\{([A-Z][A-Za-z]*)\}", r"\mathcal{<1>}"),
    ("underset_bigop", r"\\underset\s*\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}\s*\{\s*(\\sum|\\prod|\\min|\\max|\\int|\\bigcup|\\bigcap)\s*\}", "<2>_{<1>}"),
    ("mathop_unwrap", r"\\mathop\s*\{\s*(\\[a-zA-Z]+|[a-zA-Z]+)\s*\}", "<1>"),
    ("underbrace_unwrap", r"\\underbrace\s*\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}", "{<1>}"),
    ("overset_base", r"\\overset\s*\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}\s*\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}", "{<1>}"),
    ("collapse_ws", r"[ \t]{2,}", " "),
)
# Fixed value: only the first such block is rewritten, if there is one.
BODY = r"(?s)\\begin\{align\}.*?\\end\{align\}"


@dataclass(frozen=True)
class Rewrite:
    rule: str
    before: str
    after: str
    start: int  # in the text as it was
    end: int
    line: int


def normalized(text: Column) -> Column:
    """The rewritten text: a chain of built-in replacements over the block."""
    found = F.regexp_extract(text, BODY, 0)
    body = F.when(found == "", text).otherwise(found)
    at = F.when(found == "", F.lit(1)).otherwise(F.instr(text, found))
    out = body
    for _, pattern, new in RULES:
        safe = re.sub(r"<(\d)>", r"$\1", new.replace("\\", "\\\\").replace("$", r"\$"))
        out = F.regexp_replace(out, pattern, safe)
    return F.concat(F.substring(text, F.lit(1), at - 1), out, F.substring(text, at + F.length(body), F.length(text)))


def normalize(text: str) -> tuple[str, list[Rewrite]]:
    """(rewritten text, its rewrites in order). A place is told in the text as it was; what a rewrite put in has the place of what it replaced."""
    block = re.search(BODY, text)
    lo, hi = block.span() if block else (0, len(text))
    # Characters of the block, each with the place it came from.
    now, came, done = text[lo:hi], list(range(lo, hi + 1)), []
    for rule, pattern, new in RULES:
        hits = list(re.finditer(pattern, now))
        for m in reversed(hits):
            after = re.sub(r"<(\d)>", lambda g, m=m: m[int(g[1])], new)
            done.append((RULES_AT[rule], m.start(), Rewrite(rule, m[0], after, came[m.start()], came[m.end()], text.count("\n", 0, came[m.start()]) + 1)))
            now = now[: m.start()] + after + now[m.end() :]
            came[m.start() : m.end()] = [came[m.start()]] * len(after)
    return text[:lo] + now + text[hi:], [r for _, _, r in sorted(done, key=lambda x: x[:2])]


RULES_AT = {rule: i for i, (rule, _, _) in enumerate(RULES)}


def ingest(text: str, check=None) -> tuple[dict | None, list[Rewrite], list[dict]]:
    """(document, rewrites, failures): no failure, or no document. check: the faults of a document. Never raises."""
    rewrites: list[Rewrite] = []
    stage = "normalize"
    try:
        text, rewrites = normalize(text)
        stage = "parse"
        doc = latex.read(text)
        stage = "validate"
        faults = check(doc) if check else []
        if faults:
            return None, rewrites, [{"stage": stage, "message": " | ".join(map(str, faults))}]
        return doc, rewrites, []
    except Exception as e:  # noqa: BLE001 - a reported failure, whatever the text
        return None, rewrites, [{"stage": stage, "message": f"{type(e).__name__}: {e}"}]
