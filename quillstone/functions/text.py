"""Label grammar, marks, cleaning and other text functions as Column builders.

White space is written out as a class (Java's \\s is ASCII only), word boundaries as
ASCII look-arounds, and case-insensitivity is ASCII only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

WS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
WORD_START, WORD_END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

#: Label grammar, most specific first; the first match at the start wins.
_TOP = r"(?:Q(?:ues(?:tion)?)?\s*\.?\s*)?(\d{1,3})"
_SUB = r"(?:\s*[(\[]?\s*([a-hA-H])\s*[)\].]?)"
_SUBSUB = r"(?:\s*[(\[]?\s*([ivxIVX]{1,4})\s*[)\].])"
LABEL_PATTERNS = [
    ("num sub subsub", rf"^\s*{_TOP}{_SUB}{_SUBSUB}\s*[.):]?\s*"),
    ("num sub", rf"^\s*{_TOP}{_SUB}\s*[.):]?\s+"),
    ("num", rf"^\s*{_TOP}\s*[.):]\s*"),
    ("num", r"^\s*Q(?:ues(?:tion)?)?\s*\.?\s*(\d{1,3})\s*[.):]?\s+"),
    ("num", rf"^\s*{_TOP}\s*$"),
    ("subsub", r"^\s*[(\[]\s*([ivx]{1,4})\s*[)\].]\s*"),
    ("sub subsub", r"^\s*[(\[]?\s*([a-h])\s*[)\].]\s*[(\[]?\s*([ivx]{1,4})\s*[)\].]\s+"),
    ("sub", r"^\s*[(\[]\s*([a-h])\s*[)\].]\s*"),
    ("sub", r"^\s*([a-h])\s*[).]\s+"),
    ("subsub", r"^\s*([ivx]{1,4})\s*[).]\s+"),
]
ANSWER_PREFIX = r"^\s*(?:ans(?:wer)?)\s*\.?\s*[:-]?\s*"
#: Capital option letters after a number or alone (case-sensitive).
OPTION_NUMBERED = r"^\s*(?:Q(?:ues(?:tion)?)?\s*\.?\s*)?(\d{1,3})\s*[.):]?\s*[(\[]\s*[A-D]\s*[)\]]"
OPTION_BARE = r"^\s*[(\[]\s*[A-D]\s*[)\]]"
#: Marks, optional wording, page furniture, noise and continuation cues.
MARKS_PATTERNS = [
    r"(?i)[\[(]\s*(\d{1,3})\s*(?:marks?|m)\s*[\])]",
    rf"(?i){WORD_START}(\d{{1,3}})\s*marks?{WORD_END}",
    r"[\[(]\s*(\d{1,3})\s*[\])]\s*$",
]
MARKS_ONLY = r"^\s*[\[(]\s*(\d{1,3})\s*[\])]\s*$"
SECTION_HEADER = rf"(?i)^\s*sections?{WORD_END}.{{0,8}}$"
OPTIONAL_PATTERNS = [
    rf"(?i){WORD_START}attempt\s+any{WORD_END}",
    rf"(?i){WORD_START}answer\s+any{WORD_END}",
    rf"(?i){WORD_START}either{WORD_END}.*{WORD_START}or{WORD_END}",
    rf"(?i){WORD_START}or{WORD_END}\s*$",
    rf"(?i){WORD_START}optional{WORD_END}",
]
NOISE_LONE = r"^\s*[\dA-Za-z]\s*$"
NOISE_SECTION = r"(?i)^\s*SECTION\s*[-\x{2013}]?\s*[A-Z]\s*$"
CONTINUATION_CUE = rf"(?i){WORD_START}(?:cont(?:d|inued)?\.?|p\.?t\.?o\.?){WORD_END}"
#: Recognition slips, in order.
ARTIFACTS = [
    (rf"{WORD_START}rn(?=[a-z])", "m"),
    (r"(?<=[a-z])rn(?=[a-z])", "m"),
    (r"(?<=[A-Za-z])0(?=[A-Za-z])", "o"),
    (r"(?<=[0-9])l(?=[0-9])", "1"),
    (r"(?<=[A-Za-z])\|(?=[A-Za-z])", "l"),
    (r"(?<=[a-z])I(?=[a-z])", "l"),
    (r" {2,}", " "),
    (r"(?m)^[ \t]+|[ \t]+$", ""),
]
#: Words that carry no meaning for overlap.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "to",
    "was", "what", "when", "where", "which", "who", "why", "with", "explain", "define", "describe", "state", "give", "write",
    "answer", "question", "following", "briefly", "your", "you",
]
#: Subject terms that no correction may alter.
DOMAIN_TERMS = [
    "mitochondria", "mitochondrial", "mitochondrion", "photosynthesis", "photosynthetic", "endoplasmic", "reticulum",
    "phosphodiester", "polynucleotide", "nucleotide", "nucleotides", "deoxyribose", "ribose", "adenine", "thymine", "guanine",
    "cytosine", "uracil", "humification", "mineralisation", "mineralization", "decomposition", "fragmentation", "leaching",
    "catabolism", "coelacanth", "foeticide", "foetus", "foetal", "mtp", "trimester", "restriction", "endonuclease", "pvu",
    "rrna", "mrna", "trna", "snrna", "atp", "adp", "amp", "nadh", "nadph", "fadh", "dna", "rna", "pcr", "allele", "alleles",
    "homozygous", "heterozygous", "phenotype", "genotype", "meiosis", "mitosis", "chromosome", "chromosomes", "chromatid",
    "plasmid", "plasmids", "prokaryote", "eukaryote", "prokaryotic", "eukaryotic", "glycolysis", "krebs", "pyruvate", "stomata",
    "stoma", "chloroplast", "chlorophyll", "xylem", "phloem", "osmosis", "diffusion", "plasmolysis", "assertion", "reason",
]


def spaced(pattern: str) -> str:
    """A pattern with \\s widened to all white space."""
    return pattern.replace(r"[^\s", "[^" + WS[1:-1]).replace(r"\s", WS)


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+$", "")


def _blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def normalize_parts(top: Column, sub: Column, subsub: Column) -> Column:
    """Whole number, letter and roman joined by dots; blanks and nulls are skipped."""
    number = F.when(_blank_to_null(top).isNotNull(), top.cast("int").cast("string"))
    return _blank_to_null(F.concat_ws(".", number, F.lower(_blank_to_null(sub)), F.lower(_blank_to_null(subsub))))


def label_struct(text: Column, source: Column, offset: Column) -> Column:
    """First grammar rule that matches ``source``, which is ``text`` without its first ``offset`` characters."""
    out = F.lit(None)
    for groups, pattern in reversed(LABEL_PATTERNS):
        regex = "(?i)" + spaced(pattern)
        whole = F.regexp_extract(source, regex, 0)
        part = {name: F.regexp_extract(source, regex, i) for i, name in enumerate(groups.split(), 1)}
        top, sub, subsub = (part.get(k, F.lit(None).cast("string")) for k in ("num", "sub", "subsub"))
        level = 0 if groups == "num" else 2 if "subsub" in groups else 1
        found = F.struct(
            trim_all(F.substring(text, F.lit(1), offset + F.length(whole))).alias("display"),
            normalize_parts(top, sub, subsub).alias("normalized"),
            F.lit(level).alias("level"),
            trim_all(F.substring(source, F.length(whole) + 1, F.length(source))).alias("remainder"),
            top.alias("top"),
            F.lower(sub).alias("sub"),
            F.lower(subsub).alias("subsub"),
        )
        out = F.when(whole != "", found).otherwise(out)
    return out


def with_label(df: DataFrame, text: str = "text", out: str = "label", answer_prefix: bool = False) -> DataFrame:
    """Adds the leading label of ``text`` as a struct, null where there is none."""
    prefix = F.regexp_extract(F.col(text), "(?i)" + spaced(ANSWER_PREFIX), 0) if answer_prefix else F.lit("")
    df = df.withColumn("__offset", F.length(prefix)).withColumn("__source", F.expr(f"substring(`{text}`, __offset + 1)"))
    return df.withColumn(out, label_struct(F.col(text), F.col("__source"), F.col("__offset"))).drop("__offset", "__source")


def with_answer_label(df: DataFrame, text: str = "text", out: str = "label") -> DataFrame:
    """Like with_label for answers: a capital option letter is the answer, not a sub-part."""
    df = with_label(df, text, out, answer_prefix=True)
    offset = F.length(F.regexp_extract(F.col(text), "(?i)" + spaced(ANSWER_PREFIX), 0))
    df = df.withColumn("__source", F.substring(F.col(text), offset + 1, F.length(text)))
    head = F.regexp_extract("__source", spaced(OPTION_NUMBERED), 0)
    number = F.regexp_extract("__source", spaced(OPTION_NUMBERED), 1)
    nothing = F.lit(None).cast("string")
    numbered = F.struct(
        trim_all(F.substring(F.col(text), F.lit(1), offset + F.length(head))).alias("display"),
        normalize_parts(number, nothing, nothing).alias("normalized"),
        F.lit(0).alias("level"),
        trim_all(F.substring(F.col(text), offset + F.length(head) + 1, F.length(text))).alias("remainder"),
        number.alias("top"),
        nothing.alias("sub"),
        nothing.alias("subsub"),
    )
    open_sub = F.col(f"{out}.sub").isNotNull() & F.col(f"{out}.subsub").isNull()
    bare = F.col(f"{out}.top").isNull() & F.col("__source").rlike(spaced(OPTION_BARE))
    df = df.withColumn(out, F.when(open_sub & (head != ""), numbered).when(open_sub & bare, F.lit(None)).otherwise(F.col(out)))
    return df.drop("__source")


def parent_of(number: Column) -> Column:
    """All but the last dotted part, null for a single part."""
    return _blank_to_null(F.regexp_replace(F.when(number.contains("."), number), r"\.[^.]*$", ""))


def top_int(number: Column) -> Column:
    """The leading whole number of a label, or null."""
    first = F.substring_index(number, ".", 1)
    return F.when(first.rlike("^[0-9]+$"), first.cast("int"))


def roman_to_int(text: Column) -> Column:
    """Right to left; a letter counts against the total when smaller than the largest so far."""
    value = F.create_map(*[F.lit(x) for kv in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for x in kv])
    letters = F.reverse(F.split(F.lower(text), ""))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))

    def step(acc: Column, letter: Column) -> Column:
        v = F.coalesce(value[letter], F.lit(0))
        return F.struct((acc["total"] + F.when(v >= acc["most"], v).otherwise(-v)).alias("total"), F.greatest(acc["most"], v).alias("most"))

    return F.aggregate(letters, start, step, lambda acc: acc["total"])


def sort_key(number: Column) -> Column:
    """Array that orders labels: numbers before text, romans by value on the third level,
    a label before its extensions."""
    roman = "^[ivxlcdm]+$"

    def part(p: Column, i: Column) -> Column:
        numeric = F.when(p.rlike("^[0-9]+$"), p.cast("int")).when((i == 2) & p.rlike(roman), roman_to_int(p))
        return F.struct(F.when(numeric.isNotNull(), 0).otherwise(1).alias("kind"), F.coalesce(numeric, F.lit(0)).alias("num"), F.when(numeric.isNull(), p).otherwise("").alias("text"))

    return F.transform(F.split(number, r"\.", -1), part)


def natural_key(name: Column) -> Column:
    """Orders names with their digit runs as numbers."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), 1)
    return F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(r, 20, "0")).otherwise(r))


def detect_marks(text: Column, written: Callable[[str], str] = spaced) -> Column:
    """Marks printed in a text, by the first rule that finds any; ``written`` gives a rule's pattern."""
    return F.coalesce(*[_blank_to_null(F.regexp_extract(text, written(p), 1)).cast("double") for p in MARKS_PATTERNS])


def is_optional(text: Column, written: Callable[[str], str] = spaced) -> Column:
    out = F.lit(False)
    for p in OPTIONAL_PATTERNS:
        out = out | text.rlike(written(p))
    return out


def tidy_display(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?:{WS}|[.:])+$", "")


def is_noise(text: Column, confidence: Column) -> Column:
    """Blank, a lone letter or digit, a section heading, or a short fragment of low confidence."""
    t = trim_all(text)
    return (t == "") | t.rlike(spaced(NOISE_LONE)) | t.rlike(spaced(NOISE_SECTION)) | ((F.length(t) < 4) & (confidence < 0.6))


def clean_artifacts(text: Column) -> Column:
    for pattern, new in ARTIFACTS:
        text = F.regexp_replace(text, pattern, new)
    return text


def tidy_text(text: Column) -> Column:
    """Straight quotes, plain dashes, single spaces; what normalize_text does after NFKC."""
    text = F.regexp_replace(F.regexp_replace(text, "[‘’]", "'"), "[“”]", '"')
    return trim_all(F.regexp_replace(F.regexp_replace(text, "[‐-―]", "-"), f"{WS}+", " "))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_text(text: Column) -> Column:
    """Compatibility composition, then tidy_text. Python gets null for ASCII texts, which the
    composition would leave as they are."""
    plain = text.rlike(r"^\p{ASCII}*$")
    return tidy_text(F.when(plain, text).otherwise(nfkc(F.when(~plain, text))))


def tokenize(text: Column) -> Column:
    """Lower-case ASCII words of three letters and more that are not stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def title_from_filename(name: Column, default: str = "Untitled assessment") -> Column:
    spaced_name = trim_all(F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), r"[-_]+", " "))
    return F.coalesce(_blank_to_null(F.substring(spaced_name, 1, 300)), F.lit(default))


def name_from_email(email: Column) -> Column:
    parts = F.filter(F.split(F.substring_index(email, "@", 1), "[._-]+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1000))), " ")


def tenant_of(path: Column) -> Column:
    """First segment of a blob path after its scheme."""
    return F.split_part(F.regexp_replace(path, "^[a-z0-9+.-]+://", ""), F.lit("/"), F.lit(1))


_TERMS = re.compile("|".join(sorted(DOMAIN_TERMS, key=lambda t: (-len(t), t))), re.IGNORECASE)


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("terms", ArrayType(StringType()))]))
def mask_terms(text: pd.Series) -> pd.DataFrame:
    """Domain terms replaced by numbered placeholders; ``terms`` has them by number."""
    masked, terms = [], []
    for t in text:
        found: list[str] = []

        def placeholder(m: re.Match, found=found) -> str:
            found.append(m.group(0))
            return f"__DOMAIN_{len(found) - 1}__"

        masked.append(None if t is None else _TERMS.sub(placeholder, t))
        terms.append(found)
    return pd.DataFrame({"text": masked, "terms": terms})


def restore_terms(masked: Column) -> Column:
    """A masked struct's text with its terms back."""
    numbered = F.transform(masked["terms"], lambda t, i: F.struct(F.concat(F.lit("__DOMAIN_"), i.cast("string"), F.lit("__")).alias("at"), t.alias("term")))
    return F.aggregate(numbered, masked["text"], lambda acc, x: F.replace(acc, x["at"], x["term"]))


def lenient_json(text: Column, schema: str) -> Column:
    """A reply parsed as JSON: without a code fence, whole or else its first balanced span; null if neither."""
    bare = F.regexp_replace(text, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", "")
    whole = F.try_parse_json(bare).isNotNull()
    return F.coalesce(_strict(bare, schema), _strict(first_json_span(F.when(~whole, bare)), schema))


def _strict(text: Column, schema: str) -> Column:
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema, {"mode": "PERMISSIVE"}))


@F.pandas_udf(StringType())
def first_json_span(text: pd.Series) -> pd.Series:
    """The first balanced object or array in a text, with strings skipped."""

    def find(t: str | None) -> str | None:
        if t is None:
            return None
        starts = [i for i in (t.find("{"), t.find("[")) if i >= 0]
        if not starts:
            return None
        start = min(starts)
        close = {"{": "}", "[": "]"}[t[start]]
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(t)):
            c = t[i]
            if quoted:
                quoted, escaped = escaped or c != '"', not escaped and c == "\\"
            elif c == '"':
                quoted = True
            elif c == t[start]:
                depth += 1
            elif c == close:
                depth -= 1
                if not depth:
                    return t[start : i + 1]
        return None

    return text.map(find)
