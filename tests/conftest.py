import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]

from catalog_rows import NOW, table  # noqa: E402

from shelfmark.schemas import ARTIFACTS, DATASETS, JOBS, SIGNALS  # noqa: E402
from shelfmark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "shelfmark-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make(spark):
    def build(name, rows):
        schema = {
            "datasets": DATASETS, "artifacts": ARTIFACTS, "jobs": JOBS, "signals": SIGNALS,
        }[name]
        return table(spark, schema, rows)

    return build


@pytest.fixture(scope="session")
def catalog(make):
    """A small hand-written catalog."""
    datasets = make(
        "datasets",
        [
            dict(id="lab/river-levels", title="River Levels", description="Hourly gauge readings",
                 readme_text="# River Levels\nLevels of 40 rivers.", tags=["topic:water", 'say "hi"'],
                 modalities=["tabular"], license_class="mit", access_class="public",
                 size_class="1K<n<10K", languages=["en"], fingerprint="f1", indexed_at=NOW,
                 readme_tokens=6, readme_score=0.3, quality_signals='{"downloads":12,"likes":3}'),
            dict(id="lab/bird-calls", title="Bird Calls", description=None,
                 readme_text="Rufe von Vögeln, 100% CC0", tags=["topic:natur", "größe"],
                 modalities=["Audio"], license_class="cc0-1.0", access_class="public",
                 size_class="n>100M", languages=None, fingerprint=None, indexed_at=NOW,
                 readme_tokens=120, readme_score=0.7, quality_signals='{"downloads":"12"}'),
            dict(id="lab/private-maps", title=None, description="a_b path c:\\maps", readme_text=None,
                 tags=None, modalities=["image", "text"], license_class="", access_class="private",
                 size_class="weird", languages=["de", "fr"], fingerprint="f3",
                 indexed_at=datetime(2024, 2, 1), readme_tokens=None, readme_score=None),
            dict(id="plain", title="Plain river text", access_class=None, license_class="secret",
                 languages=["en"], modalities=["text"], fingerprint="", readme_tokens=60,
                 readme_score=None, indexed_at=None),
        ],
    )
    artifacts = make(
        "artifacts",
        [
            dict(dataset_id="lab/river-levels", kind="schema", payload='{"a":1}', stale=False),
            dict(dataset_id="lab/river-levels", kind="snips", payload=None, stale=True),
            dict(dataset_id="lab/bird-calls", kind="schema", payload="{}", stale=None),
            dict(dataset_id="gone", kind="schema", payload="{}", stale=False),
        ],
    )
    return datasets, artifacts
