"""Whether a text is English, from its letters and its commonest words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENGLISH = sorted({"about", "also", "and", "are", "as", "at", "be", "been", "can", "could", "each", "for", "from", "had", "has", "have", "is", "it", "its", "may", "must", "not", "of", "other", "our", "shall", "should", "such", "than", "that", "the", "their", "then", "there", "these", "they", "this", "those", "was", "we", "were", "what", "when", "where", "which", "who", "will", "with", "would", "you", "your"})
FOREIGN = sorted({"aan", "alla", "alle", "ao", "auch", "auf", "aus", "aux", "avec", "bei", "beim", "ces", "cette", "che", "como", "cuando", "da", "dans", "das", "degli", "dei", "del", "della", "delle", "dello", "dem", "der", "des", "deze", "di", "donde", "dos", "durch", "een", "ein", "eine", "einem", "einer", "eines", "el", "em", "est", "esta", "este", "esto", "está", "et", "für", "gli", "het", "il", "las", "les", "leur", "lo", "los", "mit", "muy", "más", "nel", "nella", "nicht", "niet", "non", "nous", "não", "oder", "ook", "os", "para", "pela", "pelo", "pero", "por", "pour", "questa", "questo", "qui", "sich", "sind", "sono", "sont", "sus", "são", "também", "um", "uma", "una", "und", "une", "uno", "vom", "von", "voor", "vous", "werden", "wird", "wordt", "zijn", "zum", "zur", "être"})
SHARE = 0.06
IMAGE = r"!\[[^\]]*\]\([^)]*\)"
#: Letters of Greek, Cyrillic, Hebrew, Arabic, Thai, Kana, CJK and Hangul.
OTHER_RANGE = "[Ͱ-ϿЀ-ԯ֐-׿؀-ۿ฀-๿぀-ヿ㐀-鿿가-힯豈-﫿]"
OTHER = rf"[\p{{L}}&&{OTHER_RANGE}]"


def non_english(text: Column) -> Column:
    """True where letters of other scripts are over 30 %, or the usual words of other languages are 6 % and the English ones are not; short texts are taken as English. Image references, whose captions are English, don't count."""
    text = F.regexp_replace(text, IMAGE, " ")
    letters, other = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(OTHER))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nl}\p{No}]+"), lambda w: w != "")
    count = lambda known: F.size(F.filter(words, lambda w: w.isin(*known)))
    n = F.size(words)
    return (
        F.when(letters < 12, False).when(other > 0.3 * letters, True).when((letters < 30) | (n < 20), False)
        .when(count(ENGLISH) >= SHARE * n, False).otherwise(count(FOREIGN) >= SHARE * n)
    )
