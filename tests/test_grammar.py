"""Requirement sentences with the trees, statuses and notes they must give."""

import pytest

from reqlake.plans import grammar

VOCABULARY = grammar.Vocabulary(
    ("CMPUT", "MATH", "STAT", "PHYS", "CHEM", "SCI", "ENCMP", "ECE", "E E", "MA PH", "PURE MATH", "BTM", "MIS"),
    (("Computing Science", "CMPUT"), ("Mathematics", "MATH"), ("Math", "MATH"), ("Pure Mathematics", "PURE MATH")),
)
MANY = "MATH 209, MATH 217, MATH 314, A(MATH 214, MATH 216)"
# Fixed values: (home, text, tree, status, part of a note)
GOLDENS = [
    ("CMPUT", "Prerequisites: CMPUT 101, 174, 175, 274, SCI 100, or ENCMP 100.", "O(CMPUT 101, CMPUT 174, CMPUT 175, CMPUT 274, SCI 100, ENCMP 100)", "parsed", None),
    ("CMPUT", "Prerequisite: CMPUT 201 or CMPUT 275.", "O(CMPUT 201, CMPUT 275)", "parsed", None),
    ("CMPUT", "Prerequisites: one of CMPUT 229, E E 380, or ECE 212, and any 300-level Computing Science course.", "A(O(CMPUT 229, E E 380, ECE 212), L(300 CMPUT))", "parsed", None),
    ("CMPUT", "Prerequisites: CMPUT 175 or 275, and CMPUT 272; and one of MATH 100, 114, 117, 134, 144, or 154.",
     "A(O(CMPUT 175, CMPUT 275), CMPUT 272, O(MATH 100, MATH 114, MATH 117, MATH 134, MATH 144, MATH 154))", "parsed", None),
    ("CMPUT", "Prerequisites: CMPUT 201 and CMPUT 204, or CMPUT 275.", "O(A(CMPUT 201, CMPUT 204), CMPUT 275)", "parsed", None),
    ("CMPUT", "Prerequisites: CMPUT 206, or CMPUT 204 and one of MATH 225 or 227.", "O(CMPUT 206, A(CMPUT 204, O(MATH 225, MATH 227)))", "parsed", None),
    ("CMPUT", "Prerequisites: CMPUT 200, 201, 204, and 291, and one of CMPUT 191 or 195.", "A(CMPUT 200, CMPUT 201, CMPUT 204, CMPUT 291, O(CMPUT 191, CMPUT 195))", "parsed", None),
    ("CMPUT", "Prerequisites: CMPUT 204 and one of MATH 102, 125, 126, or 127.", "A(CMPUT 204, O(MATH 102, MATH 125, MATH 126, MATH 127))", "parsed", None),
    ("CMPUT", "Prerequisites: CMPUT 204 or 275, 301; one of CMPUT 340, 418, and MATH 214.", "A(O(CMPUT 204, CMPUT 275), CMPUT 301, O(CMPUT 340, CMPUT 418), MATH 214)", "parsed", None),
    ("CMPUT", "Prerequisite: one of CMPUT 191 or 195; or one of CMPUT 174 or 274 or ENCMP 100, and one of STAT 151, 161, or MATH 181.",
     "O(CMPUT 191, CMPUT 195, A(O(CMPUT 174, CMPUT 274, ENCMP 100), O(STAT 151, STAT 161, MATH 181)))", "parsed", None),
    ("CMPUT", "Prerequisites: one of MATH 101, 115, 118, 136, 146 or 156.", "O(MATH 101, MATH 115, MATH 118, MATH 136, MATH 146, MATH 156)", "parsed", None),
    ("CMPUT", "Prerequisites: 201 or 275, and any 300-level Computing Science course.", "A(O(CMPUT 201, CMPUT 275), L(300 CMPUT))", "parsed", None),
    ("CMPUT", "Prerequisite: one of CMPUT 229, E E 380 or ECE 212.", "O(CMPUT 229, E E 380, ECE 212)", "parsed", None),
    ("CMPUT", "Prerequisite: Math 30, 30-1, or 30-2.", "O(MATH 30, MATH 30-1, MATH 30-2)", "parsed", None),
    ("CMPUT", None, None, "parsed", None),
    ("CMPUT", "Prerequisites: None", None, "parsed", None),
    ("CMPUT", "Prerequisites are determined by the instructor in the course outline.", None, "unparsed", "vary by section"),
    ("CMPUT", "Prerequisites: CMPUT 175. Not open to students with credit in CMPUT 274.", "CMPUT 175", "parsed", None),
    ("CMPUT", "Prerequisite: CMPUT 201. Credit cannot be obtained for both CMPUT 201 and CMPUT 275.", "CMPUT 201", "parsed", None),
    ("CMPUT", "Prerequisite: CMPUT 201 and CMPUT 204, or CMPUT 275; and permission of the Department.", "O(A(CMPUT 201, CMPUT 204), CMPUT 275)", "partial", "permission"),
    ("CMPUT", "Prerequisite: CMPUT 274.", "CMPUT 274", "parsed", None),
    ("CMPUT", "Prerequisite: any 300-level Computing Science course.", "L(300 CMPUT)", "parsed", None),
    ("CMPUT", "Prerequisites: CMPUT 174, and any 200-level course.", "A(CMPUT 174, L(200 CMPUT))", "partial", "assumed"),
    ("CMPUT", "Corequisite: one of CMPUT 201 or 275.", "O(CMPUT 201, CMPUT 275)", "parsed", None),
    ("MATH", "Prerequisite: Pure Mathematics 30 or Mathematics 30-1 or equivalent.", "O(PURE MATH 30, MATH 30-1)", "partial", "equivalent"),
    ("MATH", "Prerequisites: Mathematics 30-1 and Mathematics 31.", "A(MATH 30-1, MATH 31)", "parsed", None),
    ("MATH", "Prerequisites: One of MATH 102, 125 or 127, and either MATH 118 or MATH 216.", "A(O(MATH 102, MATH 125, MATH 127), O(MATH 118, MATH 216))", "parsed", None),
    ("MATH", "Prerequisites: MATH 225 or 227, and either MATH 209, 217, 314 or both 214 and 216.", f"A(O(MATH 225, MATH 227), O({MANY}))", "parsed", None),
    ("MATH", "Prerequisites: either MATH 209, 217, 314 or both 214 and 216.", f"O({MANY})", "parsed", None),
    ("MATH", "Prerequisite: at least one of MATH 326, MATH 327, MATH 328, MATH 329.", "O(MATH 326, MATH 327, MATH 328, MATH 329)", "parsed", None),
    ("MATH", "Prerequisite: Any 100-level MATH course.", "L(100 MATH)", "parsed", None),
    ("MATH", "Prerequisite: a 300-level MATH course.", "L(300 MATH)", "parsed", None),
    ("MATH", "Prerequisite: 400-level MATH course.", "L(400 MATH)", "parsed", None),
    ("MATH", "Prerequisite: any 300-level MATH class.", "L(300 MATH)", "parsed", None),
    ("MATH", "Prerequisite: One of MATH 209, 215, 217, 315 or MA PH 351.", "O(MATH 209, MATH 215, MATH 217, MATH 315, MA PH 351)", "parsed", None),
    ("MATH", "Prerequisites: either (1) MATH 227 or (2) MATH 228 and a 300-level MATH course or (3) MATH 226 and a 300-level MATH course.", None, "unparsed", "too complex"),
    ("MATH", "Prerequisites: MATH 326, or MATH 327, or any 300-level MATH class when combined with MATH 111 or MATH 228 (MATH 322 recommended).", None, "unparsed", "too complex"),
    ("MATH", "Prerequisite or corequisite: MATH 100.", "MATH 100", "parsed", None),
    ("MATH", "Prerequisite: MATH 436 or equivalent", "MATH 436", "partial", "equivalent"),
    ("MATH", "corequisite: MATH 516.", "MATH 516", "parsed", None),
    ("MATH", "Prerequisite MATH 227, or both MATH 225 and 228.", "O(MATH 227, A(MATH 225, MATH 228))", "parsed", None),
    ("MATH", "Prerequisites: One of MATH 102, 125 or 127 and one of MATH 209, 215.", "A(O(MATH 102, MATH 125, MATH 127), O(MATH 209, MATH 215))", "parsed", None),
    ("MATH", "Prerequisites: One of MATH 311, 411 and MATH 436.", "A(O(MATH 311, MATH 411), MATH 436)", "parsed", None),
    ("MATH", "Prerequisite: MATH 326 (MATH 322 recommended).", "MATH 326", "partial", "MATH 322"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame([(i, g[1], g[0]) for i, g in enumerate(GOLDENS)], "id int, text string, home string")
    return {r.id: r for r in grammar.parse(rows, "id", "text", "home", VOCABULARY).collect()}


@pytest.mark.parametrize("i", range(len(GOLDENS)))
def test_golden(parsed, i):
    _, _, tree, status, note = GOLDENS[i]
    assert (parsed[i].tree, parsed[i].parse_status) == (tree, status)
    if note:
        assert any(note in n for n in parsed[i].notes)


def test_negated_sentences_give_candidates(parsed):
    by_text = {g[1]: parsed[i].candidates for i, g in enumerate(GOLDENS)}
    assert by_text["Prerequisites: CMPUT 175. Not open to students with credit in CMPUT 274."] == ["CMPUT 274"]
    assert by_text["Prerequisite: CMPUT 201. Credit cannot be obtained for both CMPUT 201 and CMPUT 275."] == ["CMPUT 201", "CMPUT 275"]


def test_bare_numbers_and_exclusions(spark):
    from pyspark.sql import functions as F

    home = F.lit("CMPUT")
    rows = spark.createDataFrame([("CMPUT 204; one of MATH 209, 214, or 217",), ("any 300-level Computing Science course",)], "t string")
    out = [r[0] for r in rows.select(grammar.expand_bare_numbers(F.col("t"), home, VOCABULARY)).collect()]
    assert out == ["CMPUT 204; one of MATH 209, MATH 214, or MATH 217", "any 300-level Computing Science course"]
    rows = spark.createDataFrame(
        [("Credit may be obtained in only one of CMPUT 301, BTM 419, or MIS 419.", "CMPUT 301"), ("Credit cannot be obtained for both CMPUT 174 and CMPUT 274.", "CMPUT 174"),
         ("This course cannot be taken for credit if credit has been obtained in CMPUT 174, 175, 274, 275, or ENCMP 100.", "CMPUT 101")], "t string, own string",
    )
    out = [r[0] for r in rows.select(grammar.credit_exclusions(F.col("t"), F.col("own"), home, VOCABULARY)).collect()]
    assert out == [["BTM 419", "MIS 419"], ["CMPUT 274"], ["CMPUT 174", "CMPUT 175", "CMPUT 274", "CMPUT 275", "ENCMP 100"]]
