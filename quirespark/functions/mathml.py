"""MathML to LaTeX. A formula is a tree of any depth, which no column expression walks, so this is an Arrow UDF."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_MATH = re.compile(r"<math\b[^>]*>.*?</math\s*>", re.I | re.S)
_SYMBOL = {"×": r"\times", "÷": r"\div", "±": r"\pm", "·": r"\cdot", "≤": r"\leq", "≥": r"\geq", "≠": r"\neq", "≈": r"\approx", "∞": r"\infty", "∑": r"\sum", "∏": r"\prod", "∫": r"\int", "→": r"\to", "−": "-", "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "Δ": r"\Delta", "θ": r"\theta", "λ": r"\lambda", "μ": r"\mu", "π": r"\pi", "σ": r"\sigma", "φ": r"\phi", "ω": r"\omega", "Ω": r"\Omega", "∂": r"\partial", "∈": r"\in"}
_NAMED = {"sin", "cos", "tan", "log", "ln", "lim", "max", "min", "exp"}
_ACCENT = {"¯": "overline", "‾": "overline", "^": "hat", "→": "vec", "~": "tilde", "˙": "dot", ".": "dot"}


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2].lower()


def _kids(e: ET.Element) -> list[str]:
    return [latex(c) for c in e]


def latex(e: ET.Element) -> str:
    """LaTeX of a MathML element."""
    t, own = _tag(e), (e.text or "").strip()
    if t == "annotation" or t == "annotation-xml":
        return ""
    if t in ("mi", "mo", "mn"):
        s = "".join(_SYMBOL.get(c, c) + (" " if c in _SYMBOL and c != "−" else "") for c in own).strip()
        return f"\\{s}" if t != "mn" and s in _NAMED else s
    if t in ("mtext", "ms"):
        return rf"\text{{{own}}}"
    if t == "mspace":
        return r"\,"
    k = _kids(e)
    g = lambda i: k[i] if i < len(k) else ""
    if t == "msup":
        return f"{g(0)}^{{{g(1)}}}"
    if t in ("msub", "munder"):
        return f"{g(0)}_{{{g(1)}}}"
    if t in ("msubsup", "munderover"):
        return f"{g(0)}_{{{g(1)}}}^{{{g(2)}}}"
    if t == "mover":
        a = _ACCENT.get(("".join(e[1].itertext()).strip()) if len(e) > 1 else "")
        return rf"\{a}{{{g(0)}}}" if a else f"{g(0)}^{{{g(1)}}}"
    if t == "mfrac":
        return rf"\frac{{{g(0)}}}{{{g(1)}}}"
    if t == "msqrt":
        return rf"\sqrt{{{' '.join(k)}}}"
    if t == "mroot":
        return rf"\sqrt[{g(1)}]{{{g(0)}}}"
    if t == "mfenced":
        return rf"\left{e.get('open', '(')}{e.get('separators', ',')[:1].join(k)}\right{e.get('close', ')')}"
    if t == "mtable":
        return r"\begin{matrix}" + r" \\ ".join(k) + r"\end{matrix}"
    if t in ("mtr", "mlabeledtr"):
        return " & ".join(k)
    return " ".join(x for x in [own, *k] if x)


def convert(html: str) -> str:
    """Formulas of a page as ``$...$``, or ``$$...$$`` where they stand as blocks; what is no well-formed formula stays."""

    def one(m: re.Match) -> str:
        try:
            e = ET.fromstring(re.sub(r"&(?!#|amp;|lt;|gt;|quot;|apos;)\w+;", " ", m[0]))
        except ET.ParseError:
            return m[0]
        d = "$$" if e.get("display") == "block" else "$"
        return d + latex(e) + d

    return _MATH.sub(one, html)


@F.pandas_udf(StringType())
def mathml_to_latex(cells: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in cells:
        yield s.map(lambda x: convert(x) if isinstance(x, str) else None)
