"""Scalar functions over annotation fields: labels, null tokens, links, sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What each kind of file writes for a missing value.
NULLS = {
    "overview": (("", "-", "N", "NA"), False),
    "advanced": (("", "-", "na", "none", "nan"), True),
    "domain": (("", "-", "None"), False),
    "substrate": (("", "-", "N", "NA"), False),
    "ec": (("", "-"), False),
}
# The six classes of families.
CLASSES = "GH|GT|PL|CE|AA|CBM"


def cleaned(c: Column, dialect: str) -> Column:
    """Null where the trimmed cell is one of the dialect's null tokens."""
    tokens, any_case = NULLS[dialect]
    t = F.trim(c)
    return F.when((F.lower(t) if any_case else t).isin(*tokens), None).otherwise(t)


def whole(c: Column) -> Column:
    """A whole number from text such as "3" or "3.0"; null for anything else."""
    d = c.try_cast("double")
    return F.when(F.isnan(d), None).otherwise(d).cast("int")


def ingest_family(c: Column) -> Column:
    """Letters and digits at the start, upper case; coordinates and subfamily go."""
    return F.nullif(F.upper(F.regexp_extract(c, r"^([A-Za-z]+\d*)", 1)), F.lit(""))


def view_family(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^([A-Za-z]+\d+)", 1), F.lit(""))


def is_placeholder(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z]+0$")


def parent_family(c: Column) -> Column:
    """Benchmark labels lose their subfamily; others stay."""
    return F.when(c.rlike(rf"^({CLASSES})\d+(_\d+)?$"), F.regexp_replace(c, r"_\d+$", "")).otherwise(c)


def domain_family(c: Column) -> Column:
    """The family that a profile's name begins with, else the name."""
    name = F.regexp_replace(c, r"\.hmm$", "")
    return F.coalesce(F.nullif(F.regexp_extract(name, rf"^(({CLASSES})\d+)", 1), F.lit("")), name)


def families_in_cell(c: Column) -> Column:
    """Families of a "+"-joined cell without coordinates, in order, each once."""
    parts = F.transform(F.split(c, r"\+"), lambda x: ingest_family(F.regexp_replace(F.trim(x), r"\(.*\)", "")))
    return F.array_distinct(F.filter(parts, lambda x: x.isNotNull()))


def location(contig: Column, start: Column, end: Column, strand: Column) -> Column:
    """``contig:1,234-5,678 (+)``; a missing strand is a point."""
    return F.concat(contig, F.lit(":"), F.format_number(start, 0), F.lit("-"), F.format_number(end, 0), F.lit(" ("), F.coalesce(strand, F.lit(".")), F.lit(")"))


def ec_agreement(a: Column, b: Column) -> Column:
    """How many leading fields two enzyme numbers share; their prefix does not count, a missing one is incomparable."""
    x, y = (F.split(F.replace(c, F.lit("EC:"), F.lit("")), r"\.") for c in (a, b))
    same = lambda k: F.slice(x, 1, k) == F.slice(y, 1, k)
    bad = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(bad, "incomparable").when(x == y, "exact").when(same(3), "class3").when(same(2), "class2").when(same(1), "class1").otherwise("different")


def sanitized(seq: Column, longest: int = 1500) -> Column:
    return F.substring(F.regexp_replace(F.rtrim(F.upper(seq), F.lit("*")), "[^ACDEFGHIKLMNPQRSTVWY]", "X"), 1, longest)


def sequence_key(seq: Column) -> Column:
    return F.md5(F.regexp_replace(F.upper(seq), r"\*", ""))


def sequons(seq: Column, overlapping: bool = True) -> Column:
    """N-glycosylation sites: N, any but P, S or T."""
    pattern = "(?=(N[^P][ST]))" if overlapping else "(N[^P][ST])"
    return F.size(F.regexp_extract_all(seq, F.lit(pattern), F.lit(1)))


def share_of(seq: Column, letters: str) -> Column:
    return F.try_divide(F.length(F.regexp_replace(seq, f"[^{letters}]", "")), F.length(seq))


# The hydropathy scale of Kyte and Doolittle.
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}


def gravy(seq: Column) -> Column:
    total = sum((F.lit(v) * F.length(F.regexp_replace(seq, f"[^{k}]", "")) for k, v in HYDROPATHY.items()), F.lit(0.0))
    return F.try_divide(total, F.length(F.regexp_replace(seq, f"[^{''.join(HYDROPATHY)}]", "")))


def signal_window(seq: Column, width: int = 9, scan: int = 25) -> Column:
    """(start from 1, mean hydropathy) of the most hydrophobic window of the first residues, the first of equals; null if there is none.

    Residues without a place on the scale are left out beforehand.
    """
    letters = F.split(F.substring(F.regexp_replace(F.upper(seq), f"[^{''.join(HYDROPATHY)}]", ""), 1, scan), "")
    scale = F.create_map(*[F.lit(x) for kv in HYDROPATHY.items() for x in kv])
    values = F.filter(F.transform(letters, lambda x: F.try_element_at(scale, x)), lambda v: v.isNotNull())
    starts = F.when(F.size(values) >= width, F.sequence(F.lit(1), F.size(values) - width + 1)).otherwise(F.array().cast("array<int>"))
    means = F.transform(starts, lambda s: F.struct(F.round(F.aggregate(F.slice(values, s, F.lit(width)), F.lit(0.0), lambda a, x: a + x) / width, 9).alias("mean"), (-s).alias("before")))
    best = F.array_max(means)
    return F.when(best.isNotNull(), F.struct((-best["before"]).alias("start"), best["mean"].alias("mean")))


def has_signal(seq: Column, least: float = 1.6, last_start: int = 15) -> Column:
    best = signal_window(seq)
    return F.coalesce((best["mean"] >= least) & (best["start"] <= last_start), F.lit(False))


def masked(letters: Column, confidence: Column, least: float) -> Column:
    """Letters whose confidence is too low become "#"."""
    return F.array_join(F.zip_with(F.split(letters, ""), confidence, lambda x, c: F.when(c < least, "#").otherwise(x)), "")


def padded(seq: Column, start: Column, end: Column, pad: int = 10, least: int = 20) -> Column:
    """A domain's part of a sequence with ``pad`` letters on either side; null when shorter than ``least``."""
    a, b = F.greatest(start - pad, F.lit(1)), F.least(end + pad, F.length(seq))
    return F.when(b - a + 1 >= least, F.substr(seq, a, b - a + 1))


def wrapped(seq: Column, width: int = 60) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")


# Prefixes of labels that have a page, member databases by the name of an analysis, addresses.
LINKED = "GH|GT|PL|CE|AA|CBM|SLH|cohesin|dockerin"
MEMBER_DATABASES = {"pfam": "pfam", "panther": "panther", "smart": "smart", "prosite": "prosite", "prosite_profiles": "profile", "prosite_patterns": "prosite", "cdd": "cdd", "tigrfam": "ncbifam", "ncbifam": "ncbifam", "superfamily": "ssf", "prints": "prints", "hamap": "hamap", "pirsf": "pirsf", "gene3d": "cathgene3d", "cath-gene3d": "cathgene3d"}
ENTRY = "https://www.ebi.ac.uk/interpro/entry/"


def family_link(c: Column) -> Column:
    return F.when(F.trim(c).rlike(rf"(?i)^({LINKED})"), F.concat(F.lit("http://www.cazy.org/"), F.trim(c), F.lit(".html")))


def ec_link(c: Column) -> Column:
    """Whole enzyme numbers only."""
    return F.when(F.trim(c).rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.concat(F.lit("https://enzyme.expasy.org/EC/"), F.trim(c)))


def go_link(c: Column) -> Column:
    return F.when(F.upper(F.trim(c)).startswith("GO:"), F.concat(F.lit("https://www.ebi.ac.uk/QuickGO/term/"), F.trim(c)))


def interpro_link(c: Column) -> Column:
    return F.when(F.upper(c).startswith("IPR"), F.concat(F.lit(f"{ENTRY}InterPro/"), c, F.lit("/")))


def signature_link(analysis: Column, c: Column) -> Column:
    """A signature's page in its member database; null for an analysis without one."""
    sub = F.create_map(*[F.lit(x) for kv in MEMBER_DATABASES.items() for x in kv])
    return F.concat(F.lit(ENTRY), F.try_element_at(sub, F.lower(F.trim(F.coalesce(analysis, F.lit(""))))), F.lit("/"), F.nullif(c, F.lit("")), F.lit("/"))


def resistance_link(c: Column) -> Column:
    number = F.nullif(F.regexp_extract(F.trim(c), r"(?i)^ARO:?(\d+)$", 1), F.lit(""))
    return F.concat(F.lit("https://card.mcmaster.ca/ontology/"), number)


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.5, "HIGH").when(c >= 0.05, "LOW").when(c.isNotNull(), "VERY_LOW")


def instability_class(c: Column) -> Column:
    return F.when(c < 40, "stable").when(c.isNotNull(), "unstable")


# Spellings of feature types, and the types that have a place of their own.
FEATURE_ALIASES = {"domains": "domain", "structure_hits": "structure_hit", "signal_peptides": "signal_peptide", "ec": "ec_prediction"}
FEATURE_TYPES = ("signal_peptide", "tm_topology", "structure", "domain", "structure_hit", "localization", "physicochem", "ec_prediction")


def feature_type(c: Column) -> Column:
    alias = F.create_map(*[F.lit(x) for kv in FEATURE_ALIASES.items() for x in kv])
    named = F.coalesce(F.try_element_at(alias, c), c)
    return F.when(named.isin(*FEATURE_TYPES), named).otherwise("other")


def first_whole(*values: Column) -> Column:
    """The first of several values that reads as a whole number."""
    return F.coalesce(*map(whole, values))


def cell_kind(c: Column) -> Column:
    """What a cell of free content holds: json, int, float, empty or text."""
    t = F.trim(c)
    return (
        F.when(t.isNull(), None)
        .when(t.isin("", "-"), "empty")
        .when(t.rlike(r"^[\[{]") & F.try_parse_json(t).isNotNull(), "json")
        .when(t.rlike(r"^-?[0-9]+$"), "int")
        .when(t.try_cast("double").isNotNull(), "float")
        .otherwise("text")
    )


def canonical_id(c: Column) -> Column:
    return F.translate(c, "|", "-")


def last_field(c: Column, sep: str = "|") -> Column:
    return F.substring_index(c, sep, -1)


def localization_from_signal(prediction: Column) -> Column:
    """Secreted where the prediction names a signal peptide."""
    p = F.upper(F.coalesce(prediction, F.lit("")))
    return F.when(p.contains("SP") | p.isin("SIGNAL", "SEC/SPI"), "Extracellular").otherwise("Intracellular")


def signal_span(topology: Column) -> Column:
    """(start, end) of the last signal segment of ``signal:a-b|...``; null if it does not parse."""
    parts = F.filter(F.split(topology, r"\|"), lambda x: x.startswith("signal:"))
    ends = F.regexp_extract_all(F.element_at(parts, -1), F.lit(r"^signal:\s*(\d+)\s*-\s*(\d+)\s*$"), F.lit(1))
    stop = F.regexp_extract_all(F.element_at(parts, -1), F.lit(r"^signal:\s*(\d+)\s*-\s*(\d+)\s*$"), F.lit(2))
    return F.when((F.size(parts) > 0) & (F.size(ends) > 0), F.struct(F.get(ends, F.lit(0)).cast("int").alias("start"), F.get(stop, F.lit(0)).cast("int").alias("end")))


def scaled(v: Column, lo: float, hi: float) -> Column:
    """A confidence scaled to 0..1 by a range, clamped."""
    return F.least(F.greatest((v - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0))


def base_pairs(n: Column) -> Column:
    return F.when(n >= 1000, F.concat(F.format_string("%.1f", F.bround(n / 1000, 1)), F.lit(" kb"))).otherwise(F.concat(n.cast("long").cast("string"), F.lit(" bp")))


def novelty_class(novelty: Column, bases: Column, new_bases: list[str]) -> Column:
    """Truly novel base family, novel subfamily, or control; null for anything else."""
    new = F.arrays_overlap(bases, F.array(*map(F.lit, new_bases)))
    return F.when((novelty == "novel_family") & new, "novel_base").when(novelty == "novel_family", "novel_subfamily").when(novelty == "novel_seq", "control")


def header_id(fields: Column) -> Column:
    """The field before the first one that names a FASTA file, else the first."""
    at = F.array_position(F.transform(fields, lambda x: x.contains(".fasta")), F.lit(True)).cast("int")
    return F.when(at > 1, F.get(fields, at - 2)).otherwise(F.get(fields, F.lit(0)))


def header_families(fields: Column) -> Column:
    return F.array_distinct(F.filter(fields, lambda x: x.rlike(rf"^({CLASSES})\d+(_\d+)?$")))


def hydrophobic_helices(seq: Column, width: int = 18, least: int = 13, letters: str = "AILMFVWC") -> Column:
    """Starts (from 1) of windows with enough hydrophobic residues, none overlapping the one before."""
    marks = F.transform(F.split(seq, ""), lambda x: F.when(F.lit(letters).contains(x) & (x != ""), 1).otherwise(0))
    starts = F.when(F.length(seq) > width, F.sequence(F.lit(1), F.length(seq) - width)).otherwise(F.array().cast("array<int>"))
    enough = F.filter(starts, lambda s: F.aggregate(F.slice(marks, s, F.lit(width)), F.lit(0), lambda a, x: a + x) >= least)
    return F.aggregate(enough, F.array().cast("array<int>"), lambda kept, s: F.when((F.size(kept) == 0) | (s >= F.element_at(kept, -1) + width), F.concat(kept, F.array(s))).otherwise(kept))
