"""Stage categories read out of report texts by a state machine over typed tokens.

A text becomes an array of tokens, each typed by a vocabulary (a layer of the
bowel wall, an organ, a distant site, a number in digits or words, a denial, a
mark), and one fold over the array carries what has been read. A clause decides
what it says when it ends, a sentence its node counts, a scan's clause its sites,
so that a denial holds for its own clause only. Reading is one expression in the row,
without Python; texts are made distinct before it, as it costs far more than a shuffle.

Fixed values, by the published staging rules: Tis, T1 (submucosa), T2 (muscle),
T3 (through it), T4a (serosa, perforation), T4b (another organ invaded; being
adherent is not enough); N by 0, 1, 2-3, 4-6 and more nodes, isolated tumour
cells counting as none, deposits (N1c) only where all nodes are free; M1a one
site, M1b more, M1c peritoneum, nodes beyond the region being a site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugespark.sources.kept import kept

DEPTHS = ("Tis", "T1", "T2", "T3", "T4a", "T4b")
_MUSCLE, _SEROSA, _ORGAN = 3, 5, 6
#: Words of each kind; a layer's and a number's are followed by its value, a site's by its name.
_LAYERS = {1: "lamina situ intramucosal intraepithelial", 2: "submucosa submucosal", 3: "muscularis", 4: "subserosa subserosal pericolic pericolonic pericolorectal perirectal mesorectum mesorectal mesocolon mesocolic", 5: "serosa serosal"}
_SITES = {
    "peritoneum": "peritoneum peritoneal omentum omental carcinomatosis",
    "liver": "liver hepatic",
    "lung": "lung lungs pulmonary",
    "bone": "bone bones osseous vertebra vertebral vertebrae skeletal",
    "brain": "brain cerebral",
    "adrenal": "adrenal adrenals",
    "ovary": "ovary ovaries ovarian",
    "nodes": "nonregional paraaortic supraclavicular mediastinal",
}
_NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
_KINDS = {
    "deny": "no not none nor never negative denies",
    "clean": "free clear intact uninvolved absent spared unremarkable normal unaffected benign cyst cysts hemangioma",
    "without": "without",
    "with": "with",
    "but": "but whereas although however while",
    "past": "through beyond past",
    "adhere": "adherent adheres adhered adhesion adhesions abuts abutting",
    "invade": "invades invaded invading invasion infiltrates infiltrating penetrates involves",
    "perforated": "perforation perforated perforates",
    "organ": "bladder uterus uterine prostate vagina ileum jejunum duodenum bowel stomach spleen kidney ureter pancreas organ organs structure structures",
    "wall": "abdominal pelvic",
    "node": "node nodes nodal lymphadenopathy",
    "deposit": "deposit deposits",
    "other": "margin margins lymphovascular perineural venous vascular polyp",
    "heading": "specimen procedure history clinical received",
    "of": "of from among",
    "examined": "examined retrieved identified sampled",
    "positive": "positive involved metastatic metastasis metastases containing",
    "isolated": "isolated",
    "scan": "ct",
    "of ": "/",
    "end": ".",
    "line": "\n",
    "stop": ";",
    "comma": ",",
}
_TOKEN = r"[a-z]+|[0-9]+|[\n.;,/]"


def _entries() -> list[tuple[str, tuple[str, int, str]]]:
    """Each word with its kind, value and name."""
    entries = [(w, (kind.strip(), 0, "")) for kind, words in _KINDS.items() for w in (words.split() or [words])]
    entries += [(w, ("layer", v, "")) for v, words in _LAYERS.items() for w in words.split()]
    entries += [(w, ("site", 0, name)) for name, words in _SITES.items() for w in words.split()]
    return entries + [(w, ("number", v, "")) for v, w in enumerate(_NUMBERS.split())]


def _vocabulary() -> Column:
    """Maps of words by their first letter: a map is searched from its begin, so each is short."""
    token = lambda kind, v, name: F.struct(F.lit(kind).alias("kind"), F.lit(v).alias("v"), F.lit(name).alias("name"))
    entries = _entries()
    own = lambda letter: F.create_map(*[x for w, t in entries if w[0] == letter for x in (F.lit(w), token(*t))])
    return F.create_map(*[x for letter in sorted({w[0] for w, _ in entries}) for x in (F.lit(letter), own(letter))])


def tokens(text: Column) -> Column:
    """The typed tokens of a text, in order; words that mean nothing here are left out."""
    low = F.lower(text)
    joined = F.regexp_replace(F.regexp_replace(low, r"\bnon-?\s?regional", "nonregional"), r"\bpara-?\s?aortic", "paraaortic")
    plain = F.concat(F.regexp_replace(joined, r"[0-9]+\.[0-9]+", " "), F.lit("\n"))
    is_number = lambda w: (w >= "0") & (w < ":") & (F.length(w) <= 9)
    number = lambda w: F.struct(F.lit("number").alias("kind"), w.try_cast("int").alias("v"), F.lit("").alias("name"))
    # most words mean nothing: a set of all words tells them before any map is searched
    known = F.filter(F.regexp_extract_all(plain, F.lit(_TOKEN), F.lit(0)), lambda w: w.isin([w for w, _ in _entries()]) | is_number(w))
    return F.transform(known, lambda w: F.when(is_number(w), number(w)).otherwise(F.try_element_at(F.try_element_at(_vocabulary(), F.left(w, F.lit(1))), w)))


#: What is carried along, with its type; numbers begin as null but for the depth and the layer.
_REPORT = {"depth": "int", "involved": "int", "examined": "int", "deposits": "int", "sites": "array<string>", "cleared": "boolean", "scan": "boolean", "heading": "boolean", "before": "string"}
_OF_SENTENCE = {"nodes": "boolean", "none": "boolean", "isolated": "boolean", "far": "boolean", "part": "int", "whole": "int", "awaits": "string", "denies": "boolean"}
_OF_CLAUSE = {"layer": "int", "organ": "boolean", "adheres": "boolean", "invades": "boolean", "past": "boolean", "denied": "boolean", "other": "boolean", "dep": "boolean", "number": "int", "seen": "array<string>"}


def _nothing(name: str) -> Column:
    """The value of a name before anything is read."""
    kind = (_REPORT | _OF_SENTENCE | _OF_CLAUSE)[name]
    if kind.startswith("array"):
        return F.array().cast(kind)
    return F.lit({"boolean": False, "string": ""}.get(kind, 0 if name in ("depth", "layer") else None)).cast(kind)


def _step(state: Column, token: Column) -> Column:
    """What has been read after one more token."""
    s = {name: state[name] for name in _REPORT | _OF_SENTENCE | _OF_CLAUSE}
    kind, v, before = token["kind"], token["v"], state["before"]
    of = lambda *kinds: kind.isin(*kinds)
    sentence_ends = of("end", "line", "stop")
    # "not through" takes back the denial, and isn't past
    taken_back = of("past") & (before == "deny")
    clause_ends = sentence_ends | of("comma", "but", "without") | (of("deny") & (before == "with"))
    # what the clause said
    organ = s["organ"] & (~s["adheres"] | s["invades"])
    said = F.when(s["denied"] | s["other"] | s["dep"] | s["nodes"] | s["scan"] | s["heading"], 0).otherwise(F.when(organ, _ORGAN).otherwise(s["layer"]))
    depth = F.when(clause_ends, F.greatest(s["depth"], said)).otherwise(s["depth"])
    counted = F.coalesce(s["number"], F.when(s["denied"], 0))
    deposits = F.when(clause_ends & s["dep"], F.coalesce(s["deposits"], counted)).otherwise(s["deposits"])
    sites = F.when(clause_ends & s["scan"], F.array_union(s["sites"], s["seen"])).otherwise(s["sites"])
    # what the sentence said of nodes: those beyond the region are a site, cells alone are none
    told = of("end", "line", "stop") & s["nodes"] & ~s["scan"] & ~s["heading"]
    far = told & s["far"]
    part = F.when(s["isolated"], 0).otherwise(F.coalesce(s["part"], F.when(s["none"], 0)))
    involved = F.when(told & ~s["far"], F.coalesce(s["involved"], part)).otherwise(s["involved"])
    examined = F.when(told & ~s["far"], F.coalesce(s["examined"], s["whole"])).otherwise(s["examined"])
    sites = F.when(far & ~s["none"] & (F.coalesce(s["part"], F.lit(1)) > 0), F.array_union(sites, F.array(F.lit("nodes")))).otherwise(sites)

    after = {k: F.when(clause_ends, _nothing(k)).otherwise(s[k]) for k in _OF_CLAUSE}
    after |= {k: F.when(sentence_ends, _nothing(k)).otherwise(s[k]) for k in _OF_SENTENCE}
    denying = of("deny", "without")
    # a layer that is "not beyond" is reached
    only_to = of("layer") & after["denied"] & after["past"]
    reached = F.when(of("layer"), F.when(after["past"] & (v == _MUSCLE) & ~only_to, _MUSCLE + 1).otherwise(v)).when(of("perforated") | (of("site") & (token["name"] == "peritoneum")), _SEROSA).otherwise(0)
    layer = F.greatest(after["layer"], reached)
    in_scan = s["scan"] & ~of("line")
    seen = F.when(in_scan & of("site") & ~after["denies"], F.array_union(after["seen"], F.array(token["name"]))).when(of("clean"), F.array().cast("array<string>")).otherwise(after["seen"])
    at_ratio = of("of") & before.isin("number", "deny")
    first = F.when(at_ratio & after["part"].isNull(), F.when(before == "deny", 0).otherwise(after["number"])).when(of("positive") & after["part"].isNull(), after["number"]).otherwise(after["part"])
    second = F.when(of("number") & (after["awaits"] == "whole") & after["whole"].isNull(), v).when(of("examined") & after["whole"].isNull(), after["number"]).otherwise(after["whole"])
    used = of("positive", "examined")
    awaits = F.when(at_ratio, "whole").when(of("positive") & after["number"].isNull() & after["part"].isNull(), "part").when(of("number"), "").otherwise(after["awaits"])
    first = F.when(of("number") & (after["awaits"] == "part") & first.isNull(), v).otherwise(first)
    return F.struct(
        depth.alias("depth"), involved.alias("involved"), examined.alias("examined"), deposits.alias("deposits"), sites.alias("sites"),
        (s["cleared"] | (in_scan & (of("deny", "without", "clean")))).alias("cleared"),
        F.when(of("line"), False).otherwise(s["scan"] | of("scan")).alias("scan"),
        F.when(of("line"), False).otherwise(s["heading"] | (of("heading") & (before == "line"))).alias("heading"),
        kind.alias("before"),
        (after["nodes"] | of("node")).alias("nodes"), (after["none"] | of("deny", "clean")).alias("none"), (after["isolated"] | of("isolated")).alias("isolated"),
        (after["far"] | (of("site") & (token["name"] == "nodes"))).alias("far"), first.alias("part"), second.alias("whole"), awaits.alias("awaits"), (after["denies"] | (in_scan & denying)).alias("denies"),
        layer.alias("layer"), (after["organ"] | of("organ") | (of("wall")) | (of("site") & ~token["name"].isin("peritoneum", "nodes"))).alias("organ"),
        (after["adheres"] | of("adhere")).alias("adheres"), (after["invades"] | of("invade")).alias("invades"),
        F.when(of("layer"), False).when(of("past"), ~taken_back).otherwise(after["past"]).alias("past"),
        F.when(taken_back | only_to, False).otherwise(after["denied"] | denying | of("clean")).alias("denied"),
        (after["other"] | of("other")).alias("other"), (after["dep"] | of("deposit")).alias("dep"),
        F.when(of("number") & (after["awaits"] != "whole"), v).when(used | of("number"), F.lit(None).cast("int")).otherwise(after["number"]).alias("number"), seen.alias("seen"),
    )


def node_category(involved: Column, deposits: Column) -> Column:
    """N of the involved nodes; deposits count only where every node is free, and are none where not told."""
    return (
        F.when(involved > 6, "N2b").when(involved > 3, "N2a").when(involved > 1, "N1b").when(involved == 1, "N1a")
        .when(involved == 0, F.when(F.coalesce(deposits, F.lit(0)) > 0, "N1c").otherwise("N0"))
    )


def read_reports(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, t, n, m, involved, examined, deposits, sites: what each report says, null where it doesn't.

    Equal texts are read once. A null or empty report says nothing. m is M0 only where the scan's line
    denies something and names no site.
    """
    start = F.struct(*[(F.lit("line") if k == "before" else _nothing(k)).alias(k) for k in _REPORT | _OF_SENTENCE | _OF_CLAUSE])
    given = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # a table: it is small enough to broadcast, or both sides are shuffled and a text of many reports can be split
    texts = kept(given.select("_text").distinct().select("_text", F.aggregate(tokens(F.col("_text")), start, _step).alias("r")), "reports")
    read = given.join(texts, "_text").select(key, "r")
    sites = F.col("r.sites")
    m = F.when(F.array_contains(sites, "peritoneum"), "M1c").when(F.size(sites) > 1, "M1b").when(F.size(sites) == 1, "M1a").when(F.col("r.cleared"), "M0")
    t = F.get(F.array(*[F.lit(d) for d in DEPTHS]), F.col("r.depth") - 1)
    return read.select(key, F.when(F.col("r.depth") > 0, t).alias("t"), node_category(F.col("r.involved"), F.col("r.deposits")).alias("n"), m.alias("m"), "r.involved", "r.examined", "r.deposits", sites.alias("sites"))
