"""Scratch folders, the shared writer, and the entry without the optional part."""

import subprocess
import sys
import threading
from pathlib import Path

import pytest

from trackloom import session

ROOT = Path(__file__).resolve().parent.parent


def test_scratch_needs_a_shared_folder_on_clusters(spark, monkeypatch):
    class Remote:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            class getConf:  # noqa: N801
                get = staticmethod(lambda key: None)

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.scratch(Remote, "x")


def test_written_tables_are_cleared(spark):
    df = session.written(spark.range(10), "ten")
    assert df.count() == 10
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert Path(path).exists()
    mine = [p for p in session._made if p.endswith(path)]
    assert session.clear_scratch(spark, mine) == 1 and not Path(path).exists() and not [p for p in session._made if p.endswith(path)]


def test_concurrent_writers_leave_the_setting_as_it_was(spark):
    before = spark.conf.get(session._RELEASE)
    threads = [threading.Thread(target=lambda: session.written(spark.range(100), "many")) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert spark.conf.get(session._RELEASE) == before and not session._writers


def run(code):
    return subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {str(ROOT)!r})\n" + code], capture_output=True, text=True, timeout=120)


BLOCK = """
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.partition(".")[0] in BLOCKED or name in BLOCKED:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
names = e.queries()
print(len(names), sum(n.startswith("op") or n == "pipeline" for n in names), set(e.oracle_sql()) <= set(names))
"""


@pytest.mark.parametrize("gone", [["corpus_pipeline"], ["trackloom.llm"], ["corpus_pipeline", "trackloom.llm"], ["xxhash"], ["public_tokenizers"]])
def test_entry_without_the_optional_part(gone):
    done = run(f"BLOCKED = {gone!r}\n" + BLOCK)
    assert done.returncode == 0, done.stderr
    total, optional, known = done.stdout.split()
    assert int(total) >= 50 and optional == "0" and known == "True"
