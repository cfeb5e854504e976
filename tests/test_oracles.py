"""Every SQL text can be built without a JVM, a jar or a Spark session."""

import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent


def test_oracles_build_without_jars(tmp_path):
    code = (
        "import glob, zipfile\n"
        "def refuse(*a, **k): raise FileNotFoundError('no jar here')\n"
        "zipfile.ZipFile = refuse; glob.glob = refuse\n"
        "from termlens.plans import catalog\n"
        "print(len([b() for b in catalog.ORACLES.values()]))\n")
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[-1]) >= 56


@pytest.mark.parametrize("language, code", [("english", "en"), ("german", "de")])
def test_lists_equal_sparks(spark, language, code):
    from termlens.functions.stopwords import stopwords_for

    try:
        theirs = list(spark._jvm.org.apache.spark.ml.feature.StopWordsRemover.loadDefaultStopWords(language))
    except Exception:  # noqa: BLE001 - a PySpark without the ML jar
        pytest.skip("Spark ML is not installed")
    assert list(stopwords_for(code, "plain")) == theirs
