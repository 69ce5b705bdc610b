"""python -m fogline COMMAND: ingest recordings, build models, evaluate configurations, calibrate, report."""

from __future__ import annotations

import argparse

from .operators.belief import configurations
from .plans import evaluation
from .session import clear_stored, local_session
from .sources import recordings
from .sources.store import MatchStore, model_name, read_if_there, read_splits


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="fogline", description=__doc__)
    parser.add_argument("command", choices=("ingest", "build", "evaluate", "calibrate", "report"))
    parser.add_argument("root", help="folder of the match store")
    parser.add_argument("--sources", nargs="+", default=["hltv"])
    parser.add_argument("--splits", nargs="*", help="only matches of these splits")
    parser.add_argument("--lists", nargs="*", default=[], help="CSV files of demo_id, split; later ones override")
    parser.add_argument("--only", nargs="*", help="parts to build again")
    parser.add_argument("--models", nargs="+", default=["last_seen", "prior", "hmm"], help="configurations, or all")
    parser.add_argument("--reference", help="the model that others are compared with")
    parser.add_argument("--draws", type=int, default=2000, help="resamples of an interval")
    parser.add_argument("--out", default="run", help="name of the run")
    parser.add_argument("--recordings", help="folder of recordings as JSON lines, by source and demo_id")
    parser.add_argument("--cpus", default="*")
    a = parser.parse_args(argv)
    spark = local_session(a.cpus)
    store, name, samples = MatchStore(spark, a.root), model_name(a.sources), f"{a.root}/runs/{a.out}/samples"
    demos = None
    if a.splits:
        demos = store.demos(a.splits, a.sources, [read_splits(spark, p) for p in a.lists])
    if a.command == "ingest":
        read, failed = recordings.ingest(store, a.recordings)
        read.show(200, truncate=False)
        failed.show(200, truncate=False)
    elif a.command == "build":
        evaluation.fit(store, name, demos, a.only)
    elif a.command == "evaluate":
        chosen = list(configurations()) if a.models == ["all"] else a.models
        evaluation.evaluate(store, name, chosen, demos).write.mode("overwrite").parquet(samples)
    found = read_if_there(spark, samples)
    if a.command == "calibrate" and found is not None:
        for kind, loss in evaluation.calibrate(store, name, found, a.models[-1]).items():
            print(f"{kind}: {loss:.4f}")
    if a.command in ("evaluate", "report") and found is not None:
        evaluation.report(found).orderBy("model", "slice", "horizon").show(200, truncate=False)
        evaluation.write_tables(found, f"{a.root}/runs/{a.out}", a.reference, a.draws)
    clear_stored(spark)


if __name__ == "__main__":
    main()
