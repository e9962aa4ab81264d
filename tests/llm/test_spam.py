import pytest

from tracemill.llm.spam import find_spam, stuffed_share

STUFF = [
    "buy cache online / handler agent / nojaze retry / buy cache online / handler agent / herali review / nojaze retry / buy cache online",
    "\n".join(f"https://mijeze-{i}.example/hedige/bez{i}" for i in range(8)),
    "#socketagent #discount | #socketagent | #buyrefundonline | #podobe #online | #socketagent",
    "\n".join(f"tag:pipeline size:{'SML'[i % 3]} colour:wide brand:agent{i % 4}" for i in range(9)),
    "buy handler online €24\nsijogo review $84\nFREE\nbuy handler online ✓13\neager trigger ✓67\nTOP\neager trigger €93",
    '<a href="//a.example/x">cheap kits</a>\n<a href="//b.example/y">cheap kits</a>\n<a href="//c.example/z">best kits</a>',
    "Looking for fokeve filter? Our fokeve filter is the near me fokeve filter. Why fokeve filter? Because fokeve filter means top fokeve filter, says every fokeve filter fan.",
    " ".join(f"betahi in {t} Reni{i}" for i, t in enumerate(["Silberquell", "Osken", "Fennwick", "Torvalle"] * 6)),
]
FINE = [
    "The queue service keeps a lease for every worker. When the lease expires, another worker may take the job, so a slow worker can find its result refused.",
    "\n".join(f"2026-01-0{i + 1} 10:00:0{i} ERROR worker.lease failed: store returned 50{i}" for i in range(8)),
    "\n".join(f"def load_{n}(path, limit={i}):\n    return open_{n}(path)[:limit]" for i, n in enumerate("abcdef")),
    "\n".join(f"pack-{n}==1.{i}.0" for i, n in enumerate("abcdefgh")),
    "│   ├── a_handler.py\n│   ├── b_handler.py\n│   └── c_handler.py",
    "\n".join(f"- [doc {i}](https://a.example/{i}): It tells how the {w} is set up and what to check when it fails." for i, w in enumerate(["cache", "queue", "store", "proxy"])),
    "mesore,cache,704,67.21,second\nlapiha,queue,12,9.01,first\nkinelo,store,5,1.20,last",
    "", "   \n",
]


@pytest.mark.parametrize("text", STUFF)
def test_stuff(text):
    assert stuffed_share(text) > 0.5


@pytest.mark.parametrize("text", FINE)
def test_fine(text):
    assert stuffed_share(text) <= 0.5


def test_more_than_half_counts():
    assert stuffed_share(FINE[0] + "\n" + STUFF[2]) < 0.5 < stuffed_share(FINE[0] + "\n" + STUFF[2] * 4)


def test_table(spark):
    rows = [(1, STUFF[0]), (2, STUFF[0]), (3, FINE[0]), (4, None), (5, ""), (6, STUFF[1] * 400), (7, FINE[1] * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0.9 as share", "3 as id")
    assert sorted(r["doc_id"] for r in find_spam(df).collect()) == [1, 2, 6]
    assert find_spam(df.where("false")).count() == 0
