"""The entry module with and without the optional folder."""

import os
import shutil
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from assaytrail import session

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q)"


def names_after_import(folder) -> list[str]:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, env=env, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_import_without_the_optional_folder(tmp_path, with_pipeline):
    shutil.copytree(ROOT / "assaytrail", tmp_path / "assaytrail", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if with_pipeline and (ROOT / "corpus_pipeline.py").exists() else [])]:
        shutil.copy(ROOT / name, tmp_path / name)
    count, operators, pipeline = names_after_import(tmp_path)
    assert int(count) > 100 and operators == "0" and pipeline == "False"


def test_an_error_inside_the_optional_folder_is_raised(tmp_path):
    shutil.copytree(ROOT / "assaytrail", tmp_path / "assaytrail", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "assaytrail" / "llm").mkdir()
    (tmp_path / "assaytrail" / "llm" / "__init__.py").write_text("")
    (tmp_path / "assaytrail" / "llm" / "queries.py").write_text("import no_such_module")
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode != 0 and "no_such_module" in out.stderr


def test_shared_folder_of_a_local_session_without_the_setting():
    def like(master, app, folder=None):
        conf = SimpleNamespace(get=lambda key, default=None: folder)
        context = SimpleNamespace(applicationId=app, master=master, getConf=lambda: conf)
        return SimpleNamespace(conf=conf, sparkContext=context)

    assert session.shared_folder(like("spark://x", "a", "/shared/")) == "/shared"
    first = session.shared_folder(like("local[2]", "first"))
    assert session.shared_folder(like("local[2]", "first")) == first != session.shared_folder(like("local[2]", "second"))
    with pytest.raises(ValueError):
        session.shared_folder(like("spark://x", "a"))
