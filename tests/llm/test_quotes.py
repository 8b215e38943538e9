import random
import re

from pyspark.sql import functions as F

from scriptorium.llm import quotes
from scriptorium.llm.common import table

SCHEMA = "thread long, id long, body string, words string, n int"


def linked(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {(r.thread, r.order): r for r in quotes.link(frame, "thread", "id", "body").collect()}


def test_nested_quotes_find_their_messages(spark):
    rows = [
        (1, 1, "Shall we meet? On Monday at noon."),
        (1, 2, "Monday is fine.\n\nOn 3 May Ann wrote:\n> Shall we meet?\n> On Monday\n> at noon."),
        (1, 3, "Tuesday, rather.\r\n> Monday is fine.\r\n>> Shall we meet? On Monday at noon."),
        (1, 4, "Another reply to the first.\n>Shall  WE meet"),
        (1, 5, "Unknown source\n> never said this."),
        (2, 1, "Shall we meet? On Monday at noon."),
        (2, 2, "> Monday is fine."),
    ]
    got = linked(spark, rows)
    assert {k: (r.parent, r.root, r.depth) for k, r in got.items()} == {
        (1, 1): (None, 1, 0), (1, 2): (1, 1, 1), (1, 3): (2, 1, 2), (1, 4): (1, 1, 1), (1, 5): (None, 5, 0), (2, 1): (None, 1, 0), (2, 2): (None, 2, 0),
    }
    assert got[1, 2].own == "Monday is fine." and got[1, 3].own == "Tuesday, rather." and got[2, 2].own == ""
    assert (got[1, 3].n_quoted, got[1, 3].n_linked, got[1, 5].n_quoted, got[1, 5].n_linked) == (3, 3, 1, 0)


def test_long_thread_and_odd_rows(spark):
    rows = [(7, i, f"Message number {i}." + (f"\n> Message number {i - 1}." if i else "")) for i in range(70)]
    rows += [(8, 1, None), (8, 2, ""), (8, 3, "> >>"), (8, 4, "word " * 50_000), (8, 4, "word " * 50_000), (None, 1, "> Message number 1."), (8, None, "a"), (None, None, None)]
    got = linked(spark, rows)
    assert all(got[7, i].depth == i and got[7, i].root == 0 for i in range(70))
    assert got[8, 3].own == "" and got[8, 4].depth == 0 and len(got) == 77
    assert linked(spark, []) == {}


def test_conversations_come_back_without_quotes(spark, sample):
    source = table(spark, sample, "conversations")
    got = quotes.link(quotes.with_quotes(source), "conv_id", "turn", "text")
    both = got.join(source, (F.col("thread") == F.col("conv_id")) & (F.col("order") == F.col("turn")))
    assert both.count() == source.count()
    assert both.where("own != trim(BOTH '\n' FROM text)").isEmpty()
    assert both.where("turn > 0 AND n_linked < n_quoted").isEmpty()
    assert both.where("turn > 0 AND parent IS NULL").count() == 0


def test_a_repeated_sentence_comes_from_the_latest_message_before(spark):
    rows = [(1, 1, "Thanks."), (1, 2, "No."), (1, 3, "Thanks."), (1, 4, "Sure.\n> Thanks."), (1, 5, "Thanks."), (2, 1, "Far."), (2, 9000, "Later.\n> Far."), (2, 9001, "Far."), (2, 20_000, "> Far.")]
    got = linked(spark, rows)
    assert [got[k].parent for k in ((1, 4), (2, 9000), (2, 20_000))] == [3, 1, 9001]


def test_an_introduction_without_quote_is_the_message_s_own(spark):
    rows = [(1, 1, "On Monday he wrote:\nnothing.\n\nOn Tuesday she wrote:\n\n> > deep\n> On Friday we wrote:\n> none\n> On Sunday I wrote:\n>\n>> far\nOn no day they wrote:")]
    got = linked(spark, rows)[1, 1]
    assert got.own == "On Monday he wrote:\nnothing.\n\n\nOn no day they wrote:"
    assert got.n_quoted == 2


def test_rows_without_key_stay_rows_of_their_own(spark):
    rows = [(None, 1, "a"), (None, 1, "a"), (1, None, None), (1, 1, "Hello there."), (1, 2, "And you.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    quoted = quotes.with_quotes(frame)
    assert quoted.count() == 5
    got = quotes.link(quoted, "conv_id", "turn", "text").collect()
    assert len(got) == 5 and [(r.parent, r.n_linked) for r in got if r.thread == 1 and r.order == 2] == [(1, 1)]
    assert sum(r.thread is None and r.own == "a" for r in got) == 2


def test_a_long_introduction_is_one(spark):
    got = linked(spark, [(1, 1, "Yes."), (1, 2, "On Monday " + "Ann and " * 100 + "Bob wrote:\n> Yes.\nNo.")])
    assert got[1, 2].own == "No." and got[1, 2].parent == 1


def plain_link(messages):
    """Threads one message after the other: each quoted sentence is looked for backwards."""
    def sentences(lines):
        found = re.split(r"(?<=[.!?])\s+", " ".join(lines))
        return {w for w in (" ".join(re.findall(r"\w+", s.lower())) for s in found) if w}

    said, out = {}, {}
    for thread, order, text in sorted(messages):
        levels = {}
        for line in text.split("\n"):
            marks = re.match(r"^\s*(?:>\s*)*", line)[0] if re.match(r"^\s*>", line) else ""
            levels.setdefault(marks.count(">"), []).append(line[len(marks):])
        best, quoted, known = None, 0, 0
        for level in sorted(k for k in levels if k):
            votes = {}
            for s in sentences(levels[level]):
                quoted += 1
                sources = [o for t, o, mine in said.get(s, []) if t == thread and o < order]
                if sources:
                    known += 1
                    votes[max(sources)] = votes.get(max(sources), 0) + 1
            if votes and best is None:
                best = max(votes, key=lambda o: (votes[o], o))
        for s in sentences(levels.get(0, [])):
            said.setdefault(s, []).append((thread, order, s))
        root, depth = (order, 0) if best is None else (out[thread, best][1], out[thread, best][2] + 1)
        out[thread, order] = (best, root, depth, quoted, known)
    return out


def test_random_threads_equal_a_plain_version(spark):
    rng = random.Random(9)
    pool = [f"{w} is {v}." for w in ("sky", "sea", "tea", "cat") for v in ("blue", "calm", "hot", "here")]
    rows = []
    for thread in range(25):
        own = {}
        for order in range(rng.randrange(1, 9)):
            lines = [" ".join(rng.sample(pool, rng.randrange(1, 3)))]
            own[order] = lines[0]
            for level in range(1, rng.randrange(1, 4)):
                lines.append("> " * level + (own[rng.choice(list(own))] if rng.random() < 0.8 else "Nobody said so."))
            rows.append((thread, order * rng.choice([1, 1, 1]) if thread % 3 else order * 3000, "\n".join(lines)))
    got = linked(spark, rows)
    assert {k: (r.parent, r.root, r.depth, r.n_quoted, r.n_linked) for k, r in got.items()} == plain_link(rows)
