"""Requirement text to boolean trees, as a fixed number of DataFrame passes.

Six separators bind from loosest to tightest (`;`  `, and`  `, or`  `,`  `and`  `or`).  Each gets one pass: fragments that
the separator cuts become inner nodes, their parts become fragments of the next pass, the rest go on unchanged.  Lists
that `one of`, `either` or `both` announce are brackets: separators inside them are masked by private-use characters
before the cut and restored after it.  What is left is read as atoms, and trees are folded bottom-up: null children go,
single children replace their parent, equal kinds merge.  No recursion, no Python on the rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlake.storage import Scratch, shuffled

# The grammar of requirement sentences.
NUMBER = r"\d{2,}(?:[A-Z]{1,2}|-\d)?"  #: of any length: a large catalogue numbers its courses with four digits and more
ONE_OF = r"(?i)\b(?:at\s+least\s+)?(?:one|any)\s+of\b|(?i)\beither\b"
SCOPE_END = r";|,\s+and\s+|\s+and\s+(?=(?:at\s+least\s+)?(?:one|any)\s+of\b|either\b)|\s+and\s+(?=[A-Z]{2,6}(?: [A-Z]{1,4})?\s+\d{2,3})"
SEPARATORS = ((r"\s*;\s*", "A"), (r"(?i)\s*,\s+and\s+", "A"), (r"(?i)\s*,\s+or\s+", "O"), (r"\s*,\s*", "A"), (r"(?i)\s+and\s+", "A"), (r"(?i)\s+or\s+", "O"))
TURNS = 3  #: tasks a core that texts are read in
COMMA_LISTS = (1, 2)  #: passes whose parts may be comma lists of the same kind
OR_LIST = r"(?i)\s*,\s*or\s+|\s*,\s*|\s+or\s+"
LEADING_CONNECTOR = r"(?i)^(?:and|or)\s+"
CONNECTOR = r"(?i)\s+(?:and|or)\s+"
SKIPPED_NUMBER = r"(?i)^\s*(?:-level|-year|\s*\))"
NONE_TEXT = r"(?i)^(none|n/?a|no prerequisites?)\.?$"
TOO_COMPLEX = r"(?i)\(\s*\d\s*\)\s*\w|when combined with|as needed|varies"
VARIES = r"(?i)determined by the instructor|defined by the instructor|may differ|depends? on the (?:subject|topic)"
ASIDE = r"\s*\(([^)]*)\)|\s*\[([^\]]*)\]"
LEVEL_MIN = r"(?i)^(?:any|a|an|the|one|another)?\s*(\d)00-level\s+(.+?)\s+(?:course|class)$"
LEVEL_MIN_BARE = r"(?i)^(?:any|a|an|the|one|another)?\s*(\d)00-level\s+(?:course|class)$"
BOTH = r"(?i)^both\s+(.+\s+and\s+.+)$"
LABELS = (
    r"(?i)^\s*Pre-?requisites?\s+or\s+co-?requisites?\s*:?\s*",
    r"(?i)^\s*Pre-?requisites?\s*(?:are|is)?\s*:?\s*",
    r"(?i)^\s*Co-?requisites?\s*(?:are|is)?\s*:?\s*",
)
INFORMATIONAL = (
    r"(?i)^(?:(?:permission|consent|approval)\s+of\s+(?:the\s+)?[\w\s,]+|(?:a\s+)?committed\s+thesis\s+supervisor"
    r"|minimum\s+gpa\s+of\s+[\d.]+|equivalent(?:\s+knowledge)?|some\s+computer\s+programming|additional\s+prerequisites.*"
    r"|no\s+programming\s+skills.*|(?:\w+[- ])?year\s+standing|restricted to .*|any introductory-level.*"
    r"|.*\bminimum grade\b.*|see note.*)\.?$"
)
NEGATION_CUES = (
    "not open to", "without credit", "excluding", "may not be", "cannot be taken", "cannot be obtained", "not eligible",
    "will not be given", "only one of", "has already been obtained", "has been obtained",
)
TOO_COMPLEX_NOTE = "Requirement structure is too complex to parse reliably; read the calendar text."
VARIES_NOTE = "Prerequisites vary by section and are set by the instructor."

_OPEN, _CLOSE, _COMMA, _AND, _OR = "", "", "", "", ""
_EDGE = r"^[\s.;,]+|[\s.;,]+$"


@dataclass(frozen=True)
class Vocabulary:
    """Subject codes, and spelled names with their codes; a table of a few hundred rows becomes one pattern."""

    codes: tuple[str, ...]
    names: tuple[tuple[str, str], ...] = ()

    @property
    def subject(self) -> str:
        return "(?:" + "|".join(re.escape(c).replace("\\ ", " ") for c in sorted(self.codes, key=lambda c: (-len(c), c))) + ")"

    @property
    def course(self) -> str:
        return rf"({self.subject})\s+({NUMBER})"

    @property
    def _codes_by_name(self) -> Column:
        return F.create_map(*[F.lit(x) for name, code in self.names for x in (name.lower(), code)])

    def spelled(self, text: Column) -> Column:
        """Names directly before a number become codes; where names overlap, the longest that begins first."""
        if not self.names:
            return text
        names = "|".join(re.escape(n).replace("\\ ", " ") for n, _ in sorted(self.names, key=lambda n: (-len(n[0]), n[0])))
        pattern = rf"(?i)\b(?:{names})\s+(?=\d)"
        found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
        codes = F.transform(found, lambda f: F.try_element_at(self._codes_by_name, F.lower(F.regexp_replace(f, r"\s+$", ""))))
        rest = F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(1)))
        spelled = F.concat(F.element_at(gaps, 1), F.array_join(F.zip_with(codes, rest, lambda c, g: F.concat(c, F.lit(" "), g)), ""))
        return F.when(F.size(found) > 0, spelled).otherwise(text)

    def code_of_name(self, name: Column) -> Column:
        """The code of a spelled name, or of an exact code; else null."""
        exact = F.when(name.rlike(f"^{self.subject}$"), F.upper(name))
        return F.coalesce(F.try_element_at(self._codes_by_name, F.lower(name)), exact) if self.names else exact


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE, "")


def expand_bare_numbers(text: Column, home: Column, vocabulary: Vocabulary) -> Column:
    """Numbers without a subject get the last subject named before them (`home` at first); `300-level` and `(1)` stay."""
    token = rf"\b(?:{vocabulary.subject})?\s*\b{NUMBER}\b"
    tokens, gaps = F.regexp_extract_all(text, F.lit(token), F.lit(0)), F.split(text, token, -1)

    def read(t: Column, after: Column) -> Column:
        return F.struct(t.alias("t"), after.alias("after"), F.regexp_extract(t, rf"^({vocabulary.subject})\s*{NUMBER}$", 1).alias("subject"), after.rlike(SKIPPED_NUMBER).alias("skipped"))

    def step(state: Column, x: Column) -> Column:
        named = x["subject"] != ""
        bare = F.concat(F.regexp_extract(x["t"], r"^(\s*)", 1), state["now"], F.lit(" "), F.trim(x["t"]))
        now = F.when(~x["skipped"] & named, F.upper(F.regexp_replace(x["subject"], r"\s+", " "))).otherwise(state["now"])
        return F.struct(now.alias("now"), F.concat(state["out"], F.when(x["skipped"] | named, x["t"]).otherwise(bare), x["after"]).alias("out"))

    # the text is cut once and not once a token: a lambda computes what it names anew for each element
    read_tokens = F.zip_with(tokens, F.slice(gaps, 2, F.greatest(F.size(gaps), F.lit(1))), read)
    return F.aggregate(read_tokens, F.struct(home.alias("now"), F.element_at(gaps, 1).alias("out")), step)["out"]


def codes_in(text: Column, home: Column, vocabulary: Vocabulary) -> Column:
    """Distinct course codes of a text in order, bare numbers resolved."""
    code = rf"\b{vocabulary.course}\b(?!\s*(?:(?i)-level|-year|\)))"
    found = F.regexp_extract_all(expand_bare_numbers(text, home, vocabulary), F.lit(code), F.lit(0))
    return F.array_distinct(F.transform(found, lambda c: F.regexp_replace(c, r"\s+", " ")))


def credit_exclusions(text: Column, own_code: Column, home: Column, vocabulary: Vocabulary) -> Column:
    return F.filter(F.coalesce(codes_in(text, home, vocabulary), F.array().cast("array<string>")), lambda c: c != own_code)


def negated(text: Column) -> Column:
    lowered = F.lower(text)
    hit = lowered.contains(NEGATION_CUES[0])
    for cue in NEGATION_CUES[1:]:
        hit = hit | lowered.contains(cue)
    return hit


def _inside(text: Column, scope: str) -> Column:
    """The text with separators masked inside every match of the scope."""
    marked = F.regexp_replace(text, scope, f"{_OPEN}$0{_CLOSE}")

    def hide(piece: Column) -> Column:
        body = F.regexp_replace(piece, f"[{_OPEN}{_CLOSE}]", "")
        masked = F.regexp_replace(F.replace(body, F.lit(","), F.lit(_COMMA)), r"(?i)(?<=\s)and(?=\s)", _AND)
        return F.when(piece.startswith(_OPEN), F.regexp_replace(masked, r"(?i)(?<=\s)or(?=\s)", _OR)).otherwise(body)

    return F.array_join(F.transform(F.split(marked, f"(?={_OPEN})|(?<={_CLOSE})", -1), hide), "")


_BOTH_SCOPE = r"(?i)\bboth\b[^;,]*"
_ONE_OF_SCOPE = rf"(?i)(?:\b(?:at\s+least\s+)?(?:one|any)\s+of\b|\beither\b).*?(?=(?:{SCOPE_END})|$)"


def _masked(text: Column) -> Column:
    announced = text.rlike(rf"(?i)\bboth\b|{ONE_OF}")
    return F.when(announced, _inside(_inside(text, _BOTH_SCOPE), _ONE_OF_SCOPE)).otherwise(text)


def _unmasked(text: Column) -> Column:
    for hidden, shown in ((_COMMA, ","), (_AND, "and"), (_OR, "or")):
        text = F.replace(text, F.lit(hidden), F.lit(shown))
    return text


def _whole_list(text: Column) -> Column:
    """Is the fragment nothing but one announced list?  A `both` group counts as the first bracket where there is one."""
    starts = text.rlike(rf"^(?:{ONE_OF})")
    body = F.regexp_replace(text, r"[.;, ]+$", "")
    has_both = text.rlike(r"(?i)\bboth\b")
    both_to_end = body.rlike(r"(?i)\bboth\b[^;,]*$") & ~F.regexp_replace(body, r"(?i)\bboth\b[^;,]*$", "").rlike(r"(?i)\bboth\b")
    shielded = _inside(body, _BOTH_SCOPE)
    one_to_end = F.length(F.regexp_extract(shielded, rf"^{_ONE_OF_SCOPE}", 0)) >= F.length(shielded)
    # a conditional and not `&`, of whose sides Spark computes what they share before it looks at the first
    return F.when(starts, F.when(has_both, both_to_end).otherwise(one_to_end)).otherwise(starts)


def _plain_list(part: Column) -> Column:
    """A part with commas and no connector of its own: a list of the kind of the separator that cut it."""
    return part.contains(",") & ~part.rlike(CONNECTOR) & ~_whole_list(F.trim(part))


def _cleaned(text: Column) -> Column:
    return F.trim(F.regexp_replace(_strip(text), LEADING_CONNECTOR, ""))


def prepare(rows: DataFrame, text: str, home: str, vocabulary: Vocabulary) -> DataFrame:
    """Adds route, body, asides, candidates: which rows get a tree, and the text it is read from.

    route is `none` (nothing required), `complex` and `varies` (not read), `negated` (only exclusions) or `tree`.
    """
    t = F.trim(F.regexp_replace(F.col(text), r"(?U)\s+", " "))
    for label in LABELS:
        t = F.regexp_replace(t, label, "")
    rows = rows.withColumn("_t", F.trim(vocabulary.spelled(t)))
    asides = F.filter(F.transform(F.regexp_extract_all("_t", F.lit(ASIDE), F.lit(0)), lambda a: F.trim(F.regexp_replace(a, r"^\s*[(\[]|[)\]]$", ""))), lambda a: a != "")
    rows = rows.withColumn("asides", asides).withColumn("_u", F.when(F.size("asides") > 0, F.trim(F.regexp_replace("_t", ASIDE, " "))).otherwise(F.col("_t")))
    rows = rows.withColumn("_s", F.split("_u", r"(?<=[.;])\s+", -1))
    rows = rows.withColumn("body", F.trim(F.array_join(F.filter("_s", lambda s: ~negated(s)), " ")))
    candidates = F.flatten(F.transform(F.filter("_s", negated), lambda s: codes_in(s, F.col(home), vocabulary)))
    route = (
        F.when(F.col(text).isNull() | (F.col("_t") == "") | F.col("_t").rlike(NONE_TEXT), "none").when(F.col("_t").rlike(TOO_COMPLEX), "complex").when(F.col("_u").rlike(VARIES), "varies")
        .when(F.col("body") == "", "negated").otherwise("tree")
    )
    rows = rows.withColumn("route", route)
    seen = F.col("route").isin("tree", "negated")
    rows = rows.withColumn("candidates", F.when(seen, candidates).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("whole", F.col("_t")).withColumn("body", F.when(F.col("route") == "tree", expand_bare_numbers(F.col("body"), F.col(home), vocabulary)))
    return rows.drop("_t", "_u", "_s")


def _bare(text: Column) -> Column:
    return _strip(F.regexp_replace(F.trim(text), rf"^(.*?)(?:{ONE_OF})", "$1"))


def _atoms(text: Column, home: Column, vocabulary: Vocabulary) -> Column:
    """struct(kind, node, said) of one atom (``_bare`` text): kind is L (leaf), D (dropped), U (not understood) or null (empty)."""
    t = text
    subject = vocabulary.code_of_name(F.trim(F.regexp_extract(t, LEVEL_MIN, 2)))
    level = F.concat(F.lit("L("), F.regexp_extract(t, LEVEL_MIN, 1), F.lit("00 "), subject, F.lit(")"))
    bare = F.concat(F.lit("L("), F.regexp_extract(t, LEVEL_MIN_BARE, 1), F.lit("00 "), home, F.lit(")"))
    course = F.concat(F.upper(F.regexp_replace(F.regexp_extract(t, f"^{vocabulary.course}$", 1), r"\s+", " ")), F.lit(" "), F.regexp_extract(t, f"^{vocabulary.course}$", 2))
    none = F.lit(None).cast("string")
    make = lambda kind, node, said: F.struct(F.lit(kind).alias("kind"), node.alias("node"), said.alias("said"))
    return (
        F.when(t == "", make(None, none, none).cast("struct<kind:string,node:string,said:string>"))
        .when(t.rlike(LEVEL_MIN), F.when(subject.isNotNull(), make("L", level, none)).otherwise(make("U", none, t)))
        .when(t.rlike(LEVEL_MIN_BARE), make("L", bare, F.concat(t, F.lit(" (subject assumed to be "), home, F.lit(")"))))
        .when(t.rlike(f"^{vocabulary.course}$"), make("L", course, none))
        .when(t.rlike(INFORMATIONAL), make("D", none, t))
        .otherwise(make("U", none, t))
    )


def atoms(prepared: DataFrame, key: str, home: str, vocabulary: Vocabulary) -> DataFrame:
    """(key, path, kinds, kind, node, said): the atoms of every text, with the numbers and kinds of the nodes above them.

    One linear chain of passes: rows that are settled (announced lists) travel on unchanged, and empty ones, of a null kind, too.
    (A filter on a computed text, or the one Spark infers for an inner explode, would copy every pass's expressions into
    the passes before it.)  A path is at most six cuts, one list and one `both` deep.
    """
    none = F.array()
    rows = prepared.where("route = 'tree'").select(
        key, F.col(home).alias("home"), none.cast("array<int>").alias("path"), none.cast("array<string>").alias("kinds"), F.col("body").alias("text"), F.lit(False).alias("listed")
    )
    for level in range(len(SEPARATORS) + 1):
        rows = rows.withColumn("text", F.when(F.col("listed"), F.col("text")).otherwise(_cleaned(F.col("text"))))
        rows = rows.withColumn("listed", F.col("listed") | _whole_list(F.col("text")))
        if level == len(SEPARATORS):
            break
        pattern, kind = SEPARATORS[level]
        parts = F.filter(F.transform(F.split(_masked(F.col("text")), pattern, -1), _unmasked), lambda p: F.trim(p) != "")
        rows = rows.withColumn("parts", F.when(F.col("listed") | ~F.col("text").rlike(pattern), F.array("text")).otherwise(parts))
        rows = rows.withColumn("cut", F.size("parts") > 1)
        if level == 0:  # a semicolon joins by AND, but by OR where a later part says so
            later = F.slice("parts", 2, F.greatest(F.size("parts"), F.lit(1)))
            kind_column = F.when(F.exists(later, lambda p: F.lower(F.trim(p)).startswith("or ")), "O").otherwise(kind)
        else:
            kind_column = F.lit(kind)
        if level in COMMA_LISTS:
            cut_again = F.flatten(F.transform("parts", lambda p: F.when(_plain_list(p), F.split(p, r"\s*,\s*", -1)).otherwise(F.array(p))))
            rows = rows.withColumn("parts", F.when(F.col("cut"), cut_again).otherwise(F.col("parts")))
        rows = rows.withColumn("kind", kind_column).select(key, "home", "path", "kinds", "listed", "cut", "kind", F.posexplode_outer("parts").alias("i", "part"))
        rows = rows.select(
            key, "home", F.when(F.col("cut"), F.concat("path", F.array("i"))).otherwise(F.col("path")).alias("path"),
            F.when(F.col("cut"), F.concat("kinds", F.array("kind"))).otherwise(F.col("kinds")).alias("kinds"),
            F.col("part").alias("text"), "listed",
        )
    for items, kind in ((_list_items, "O"), (_both_items, "A")):
        rows = rows.withColumn("items", items(F.col("text"), F.col("listed")))
        rows = rows.select(key, "home", "path", "kinds", "listed", F.col("items").isNotNull().alias("cut"), F.posexplode_outer(F.coalesce("items", F.array("text"))).alias("i", "text"))
        rows = rows.select(
            key, "home", F.when(F.col("cut"), F.concat("path", F.array("i"))).otherwise(F.col("path")).alias("path"),
            F.when(F.col("cut"), F.concat("kinds", F.array(F.lit(kind)))).otherwise(F.col("kinds")).alias("kinds"), "text", "listed",
        )
    rows = rows.withColumn("text", _bare(F.col("text")))
    return rows.withColumn("atom", _atoms(F.col("text"), F.col("home"), vocabulary)).select(key, "path", "kinds", "atom.*")


def _list_items(text: Column, listed: Column) -> Column:
    return F.when(listed, F.split(_strip(F.regexp_replace(text, rf"^(?:{ONE_OF})", "")), OR_LIST, -1))


def _both_items(text: Column, listed: Column) -> Column:
    bare = _bare(text)
    return F.when(bare.rlike(BOTH), F.split(F.regexp_extract(bare, BOTH, 1), r"(?i)\s+and\s+", -1))


def _fold_level(rows: DataFrame, depth: int) -> DataFrame:
    """The items of one depth, joined to the items of their parents."""

    def above(x: Column) -> Column:
        return F.struct(F.slice(x["path"], 1, depth - 1).alias("path"), F.slice(x["kinds"], 1, depth - 1).alias("kinds"), F.element_at(x["kinds"], depth).alias("kind"))

    def join(p: Column) -> Column:
        children = F.array_sort(F.filter("here", lambda x: F.slice(x["path"], 1, depth - 1) == p["path"]))
        flat = F.flatten(F.transform(children, lambda x: F.when(x["kind"] == p["kind"], x["children"]).otherwise(F.array(x["text"]))))
        one, first = F.size(children) == 1, children[0]
        return F.struct(
            p["path"].alias("path"), p["kinds"].alias("kinds"), F.when(one, first["kind"]).otherwise(p["kind"]).alias("kind"),
            F.when(one, first["text"]).otherwise(F.concat(p["kind"], F.lit("("), F.array_join(flat, ", "), F.lit(")"))).alias("text"), F.when(one, first["children"]).otherwise(flat).alias("children"),
        )

    rows = rows.withColumn("here", F.filter("items", lambda x: F.size(x["path"]) == depth)).withColumn("parents", F.array_distinct(F.transform("here", above)))
    return rows.withColumn("items", F.concat(F.filter("items", lambda x: F.size(x["path"]) < depth), F.transform("parents", join))).drop("here", "parents")


def _leaf() -> Column:
    """A leaf as an item of ``folded``; null for what is none."""
    item = F.struct("path", "kinds", F.lit("L").alias("kind"), F.col("node").alias("text"), F.array().cast("array<string>").alias("children"))
    return F.when(F.col("kind") == "L", item)


def folded(rows: DataFrame) -> DataFrame:
    """``rows`` with the tree of their items, in the notation A(...), O(...), L(level subject), bare codes; null without a leaf.

    A sentence's leaves meet in one row and are folded from the deepest nodes up.
    """
    for depth in range(len(SEPARATORS) + 2, 0, -1):
        rows = _fold_level(rows, depth)
    return rows.withColumn("tree", F.get("items", F.lit(0))["text"]).drop("items")


def parse(rows: DataFrame, key: str, text: str, home: str, vocabulary: Vocabulary) -> DataFrame:
    """(key, tree, parse_status, notes, unrepresented, candidates) per row.

    tree is null where nothing is required (parsed) and where the text can't be read (unparsed); partial says that a
    part of the text is not in the tree: notes names it, and unrepresented the parts that state a requirement.
    """
    scratch = Scratch(rows.sparkSession, "grammar")
    # dealt evenly, as a row costs much more time than bytes
    dealt = rows.select(key, text, home).repartition(TURNS * rows.sparkSession.sparkContext.defaultParallelism, key)
    prepared = scratch.save(prepare(dealt, text, home, vocabulary).drop(text), "prepared")
    leaves = scratch.save(atoms(prepared, key, home, vocabulary), "leaves")
    said = lambda kinds: F.transform(F.array_sort(F.collect_list(F.when(kinds & F.col("said").isNotNull(), F.struct("path", "said")))), lambda x: x["said"])
    per_text = leaves.where("kind is not null").groupBy(key).agg(F.collect_list(_leaf()).alias("items"), said(F.col("kind") != "U").alias("dropped"), said(F.col("kind") == "U").alias("unrecognized"))
    out = prepared.join(shuffled(folded(per_text)), key, "left")
    none = F.array().cast("array<string>")
    dropped, unrecognized = F.coalesce("dropped", none), F.coalesce("unrecognized", none)
    partial = (F.size(dropped) + F.size(unrecognized) + F.size("asides")) > 0
    read = F.col("route") == "tree"
    status = F.when(F.col("route").isin("none", "negated"), "parsed").when(~read | F.col("tree").isNull(), "unparsed").when(partial, "partial").otherwise("parsed")
    note = F.concat(dropped, F.transform("asides", lambda a: F.concat(F.lit("not required, mentioned only as an aside: "), a)), F.transform(unrecognized, lambda u: F.concat(F.lit("could not interpret: "), u)))
    return out.select(
        key, "tree", status.alias("parse_status"),
        F.when(F.col("route") == "complex", F.array(F.lit(TOO_COMPLEX_NOTE))).when(F.col("route") == "varies", F.array(F.lit(VARIES_NOTE))).when(read, note).otherwise(none).alias("notes"),
        F.when(F.col("route") == "complex", F.array("whole")).when(read, unrecognized).otherwise(none).alias("unrepresented"), "candidates",
    )
