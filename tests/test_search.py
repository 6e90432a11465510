"""English stems, and word search through the stored token table."""

import pytest

from rolecall.functions import stems
from rolecall.functions import fixed_values as V
from rolecall.operators import search

#: Words and their stems as the algorithm's publishers give them.
KNOWN = """consign consign consigned consign consigning consign consignment consign consistency consist
consolation consol consolatory consolatori console consol consolidating consolid consonant conson
conspicuously conspicu conspiracy conspiraci conspirators conspir constables constabl constancy constanc
knackeries knackeri knavish knavish kneeled kneel knightly knight knitted knit knives knive knopp knopp
generously generous generate generat communication communic relational relat hopping hop hoping hope happy happi
cries cri ties tie agreed agre feed feed bled bled sky sky by by say say enjoyed enjoy luxuriated luxuri
engineers engin engineering engin building build ships ship controlled control organization organ
activities activ national nation hopefulness hope electricity electr inning inning proceed proceed
news news dying die gently gentl university univers youth youth yellow yellow boyish boyish gas gas gaps gap
kiwis kiwi a a is is bees bee dogs dog apologies apolog sensational sensat decisive decis revival reviv""".split()


def test_known_stems(rows):
    pairs = list(zip(KNOWN[::2], KNOWN[1::2]))
    got = stems.with_stems(rows("word string, want string", *pairs)).collect()
    assert [(r.word, r.stem) for r in got] == pairs


def test_other_words_and_filters_on_stems(rows):
    words = rows("word string", (None,), ("",), ("x1",), ("2024",), ("straße",), ("running",), ("runs",))
    got = stems.with_stems(words)
    assert [r.stem for r in got.collect()] == [None, "", "x1", "2024", "straße", "run", "run"]
    assert sorted(r.word for r in got.where("stem = 'run'").collect()) == ["running", "runs"]
    plan = got.where("stem = 'run'")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 60000


POSTING = "id bigint, title string, org_name string, location_text string, employment_type string, description_plain string"


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    postings = spark.createDataFrame([
        (1, "Engineer", None, None, None, "Building the red bridges of Austin"),
        (2, "Engineering lead", None, None, None, "builds red bridge engines"),
        (3, "Cook", None, None, None, "Red buildings, bridges: none"),
        (4, "Driver", None, None, None, "The driver drives; engineers do not"),
        (5, None, None, None, None, None),
        (6, "Nurse", None, None, None, "bridge. Red building"),
    ], POSTING)
    folder = str(tmp_path_factory.mktemp("tokens") / "t")
    tokens = search.store_tokens(postings, folder, 16)
    return lambda query: sorted(r.id for r in search.token_search(postings, tokens, query).collect()), postings, tokens


@pytest.mark.parametrize("query, want", [
    ("engineer", [1, 2, 4]), ("engine", [1, 2, 4]), ("BUILD", [1, 2, 3, 6]), ("build bridge", [1, 2, 3, 6]),
    ('"red bridge"', [1, 2]), ('"building the red"', [1]), ('"build a red"', [1]), ('"red building"', [3, 6]),
    ("build -austin", [2, 3, 6]), ("-build", [4, 5]), ('bridge -"red building"', [1, 2]), ("nursing OR driver", [4, 6]),
    ("cook OR -bridge", [3, 4, 5]), ("the", []), ("the cook", [3]), ("missing", []), ("", []), ("OR", []),
    ('"bridge red"', [6]), ("none", [3]), ("building-red", [2]),
])
def test_search(found, query, want):
    ids, _, _ = found
    assert ids(query) == want


def test_a_search_reads_its_own_stems_only(found, spark):
    _, postings, tokens = found
    plan = search.token_search(postings, tokens, "engineer bridge")._jdf.queryExecution().executedPlan().toString()
    parts = tokens.touched(spark.createDataFrame([("engin",), ("bridg",)], "stem string"))
    assert "_part#" in plan and f"IN ({','.join(map(str, parts))})" in plan.replace(", ", ",")
    assert "PushedFilters: [In(stem, [bridg,engin])" in plan
    assert "description_plain" not in plan.split("FileScan")[1]


def test_stop_words_hold_their_places(found):
    _, postings, _ = found
    rows = {(r.stem, r.id): r.places for r in search.posting_tokens(postings).collect()}
    assert rows["red", 1] == [3] and rows["build", 1] == [1] and ("the", 1) not in rows
    assert rows["drive", 4] == [3] and rows["driver", 4] == [0, 2] and len(V.STOP_WORDS) == 127


def test_tokens_are_filed_by_block_without_a_shuffle_of_them(spark):
    postings = spark.createDataFrame([
        (i, f"w{i % 7} engineers", None, None, None, f"the w{i % 5} engineer w{i % 7} " * (i % 4)) for i in range(300)
    ], POSTING).repartition(6)
    blocks = search.token_blocks(postings)
    plan = blocks._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1  # the test's own repartition
    rows = blocks.collect()
    assert sorted(i for r in rows if r.stem is None for i in r.ids) == list(range(300))
    assert len({r.block for r in rows}) == 6 and len(rows) < 150  # rows of words, not of tokens
    want = {}
    for i in range(300):
        for place, word in enumerate(f"w{i % 7} engineers {f'the w{i % 5} engineer w{i % 7} ' * (i % 4)}".split()):
            if word != "the":
                want.setdefault((word.replace("engineers", "engineer").replace("engineer", "engin"), i), []).append(place)
    assert {(r.stem, r.id): r.places for r in search.posting_tokens(postings).collect()} == want
