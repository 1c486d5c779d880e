"""Commands over a store of parquet tables: ``python -m tidemark.cli run --store DIR --specs DIR --out FILE`` and others.

run       scores, gates and publishes the current setup of every instrument
validate  out-of-sample figures of every instrument, and folds by year
ablate    what leaving out a driver does to them
arbitrate the best forecaster of every symbol and its forecast
clean     bars whose scale is off, put right
seed      filtered copies of another database's tables; --inspect only tells its keys
fetch     series, weather by region, option chains or the squeeze file from a server into the store
land      bars that a price feed has landed as files
update    fetches, lands and cleans what a plan names, as far as it goes, and runs; one update at a time
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.bars import repair_scales
from .plans import panel, scenario, score, setups, validation
from .sources import config, feeds, ingest, landing, rest, store
from .sources.lease import lease
from .sources.shared import clean as clean_shared
from .sources.shared import materialize

STEP = 5  # every so many days a decision of the panel


def load_specs(folder: str, swaps: str | None = None) -> list[dict]:
    import yaml

    return config.load_all(folder, yaml.safe_load(Path(swaps).read_text()) if swaps else None)


def scored(env: dict[str, DataFrame], specs: list[dict], **defaults) -> DataFrame:
    return materialize(panel.scored_panel(env, env["bars"], specs, step=STEP, **defaults), "panel")


def run(spark: SparkSession, root: str, specs: list[dict], out: str, as_of: str | None = None, generated: str | None = None) -> dict:
    """Writes the published document of all instruments with prices, and returns it."""
    env = store.environment(spark, root)
    for x in score.missing_series(env, specs).collect():  # a row a parameter of the specifications
        print(f"{x.instrument}, {x.driver}: there is no series {x.series}", file=sys.stderr)
    found = materialize(setups.build_setups(env, env["bars"], specs, scored(env, specs), as_of), "setups")
    last = found.agg(F.max("as_of")).first()[0]
    day = as_of or (last.isoformat() if last else "")
    document = setups.payload(found, day, generated or dt.datetime.now(dt.UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    setups.write(document, out)
    return json.loads(document)


def validate(spark: SparkSession, root: str, specs: list[dict], oos_start: str) -> tuple[DataFrame, DataFrame]:
    """(validation, folds) of the instruments at fixed stops and targets."""
    env = store.environment(spark, root)
    rows = materialize(panel.outcomes(scored(env, specs, oos_start=oos_start)), "outcomes")
    return validation.validate(rows), validation.walk_forward(rows)


def ablate(spark: SparkSession, root: str, specs: list[dict], driver: str, oos_start: str) -> DataFrame:
    less = validation.without_driver(specs, driver)
    kept = [f for f in specs if f["id"] in {x["id"] for x in less}]
    full, reduced = (validate(spark, root, s, oos_start)[0] for s in (kept, less))
    return validation.ablation(full, reduced)


def arbitrate(spark: SparkSession, root: str, out: str, horizon: int = 20) -> dict:
    """Writes the table of winners and their forecasts, a row a symbol, and returns it."""
    rows = scenario.routed_cones(store.environment(spark, root)["closes"], horizon=horizon).orderBy("key").toJSON().collect()
    document = {"generated_horizon_days": horizon, "models": {(x := json.loads(r)).pop("key"): x for r in rows}}
    Path(out).parent.mkdir(parents=True, exist_ok=True)
    Path(out).write_text(json.dumps(document, indent=2))
    return document


def clean(spark: SparkSession, root: str, apply: bool = False) -> int:
    """How many daily bars are off in scale; with ``apply`` they are put right in the store."""
    prices = store.table(spark, root, "prices").filter("tf = 'D1'")
    rows = prices.select(F.col("symbol").alias("key"), F.to_date("ts").alias("d"), "tf", "ts", "open", "high", "low", "close", "volume")
    fixed = materialize(repair_scales(rows).filter("factor <> 1"), "fixed")
    if apply:
        store.put(spark, root, "prices", fixed.withColumnRenamed("key", "symbol"))
    return fixed.count()


def seed(spark: SparkSession, root: str, url: str, plan: dict[str, dict]) -> dict[str, int]:
    """Copies tables of another database: ``plan`` has, by target, ``table``, ``key`` and ``keys``. Returns rows by target."""
    store.create(spark, root)
    counts = {}
    for target, want in plan.items():
        rows, counted = ingest.seed(store.external(spark, url, want["table"]), target, want.get("keys"), want.get("key"))
        store.put(spark, root, target, rows)  # the source is read once, and counted on the way
        counts[target] = counted.get["rows_seeded"]
        store.put(spark, root, "seed_log", ingest.seed_log(spark, want["table"], target, counts[target]))
    return counts


def inspect(spark: SparkSession, url: str, plan: dict[str, dict]) -> DataFrame:
    """(target, key, status): which wanted keys the other database has."""
    parts = []
    for target, want in plan.items():
        wanted = spark.createDataFrame([(k,) for k in want["keys"]], "key string")
        there = store.external(spark, url, want["table"]).select(F.col(want["key"]).alias("key"))
        parts.append(ingest.key_report(there, wanted, "key").select(F.lit(target).alias("target"), "key", "status"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fetch(spark: SparkSession, root: str, kind: str, url: str, keys: list[str] | None = None, start: str = "2000-01-01", secret: str | None = None) -> int:
    """Fetches macro, energy or weather series, option chains or the squeeze file and upserts them; the rows fetched.

    ``secret`` names the API key, which comes from the environment or the secrets file and so stands in no command line.
    """
    return feeds.fetch(spark, root, kind, url, keys, start, rest.secret(secret) if secret else None)


def update(spark: SparkSession, root: str, specs: list[dict], out: str, plan: dict, generated: str | None = None) -> dict[str, str] | None:
    """Brings the store up to date and publishes: what became of each step, or None while another update is at it.

    ``plan`` has ``fetch`` (a list of what ``fetch`` takes: kind, url, keys, start, secret), ``land`` (a folder) and ``clean``.
    These steps may fail, as yesterday's data are better than no document; errors are told by their type alone,
    as their texts may hold an API key. If the run itself fails, so does the update.
    """
    steps = [(f"fetch {x['kind']}", lambda x=x: fetch(spark, root, **x)) for x in plan.get("fetch", [])]
    if plan.get("land"):
        steps.append(("land", lambda: landing.land(spark, root, plan["land"])))
    if plan.get("clean"):
        steps.append(("clean", lambda: clean(spark, root, apply=True)))
    with lease(spark, root) as mine:
        if not mine:
            return None
        store.create(spark, root)
        told = {}
        for name, step in steps:
            try:
                step()
                told[name] = "done"
            except Exception as e:
                told[name] = f"failed: {type(e).__name__}"
        document = run(spark, root, specs, out, generated=generated)
        return told | {"run": f"{len(document['signals'])} signals"}


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str, **needed: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        c.add_argument("--store", required=True)
        for o in options:
            c.add_argument(f"--{o}", default=needed.get(o.replace("-", "_")))
        return c

    command("run", "specs", "swaps", "as-of", "out", out="setups.json")
    command("validate", "specs", "swaps", "oos-start", oos_start="2023-01-01")
    command("ablate", "specs", "swaps", "oos-start", "driver", oos_start="2025-01-01")
    command("arbitrate", "out", out="scenario_models.json")
    command("clean").add_argument("--apply", action="store_true")
    command("seed", "url", "plan").add_argument("--inspect", action="store_true")
    command("fetch", "kind", "url", "keys", "start", "secret", kind="macro", start="2000-01-01")
    command("land", "folder")
    command("update", "specs", "swaps", "plan", "out", out="setups.json")
    args = top.parse_args(argv)
    spark = SparkSession.builder.appName(f"tidemark {args.command}").getOrCreate()
    specs = load_specs(args.specs, args.swaps) if getattr(args, "specs", None) else []
    if args.command == "run":
        document = run(spark, args.store, specs, args.out, args.as_of)
        print(f"{args.out}: {len(document['signals'])} signals, {sum(s['published'] for s in document['signals'])} published, as of {document['as_of']}")
    elif args.command == "validate":
        for df in validate(spark, args.store, specs, args.oos_start):
            df.orderBy("instrument").show(1000, truncate=False)
    elif args.command == "ablate":
        deltas = materialize(ablate(spark, args.store, specs, args.driver, args.oos_start), "ablation")
        deltas.orderBy("instrument").show(1000, truncate=False)
        validation.ablation_summary(deltas).show()
    elif args.command == "arbitrate":
        document = arbitrate(spark, args.store, args.out)
        print(f"{args.out}: {len(document['models'])} symbols")
    elif args.command == "clean":
        print(f"{clean(spark, args.store, args.apply)} bars off in scale" + (", put right" if args.apply else ""))
    elif args.command == "seed":
        plan = json.loads(Path(args.plan).read_text())
        if args.inspect:
            inspect(spark, args.url, plan).orderBy("target", "key").show(1000, truncate=False)
        else:
            print(seed(spark, args.store, args.url, plan))
    elif args.command == "land":
        landing.land(spark, args.store, args.folder)
    elif args.command == "update":
        told = update(spark, args.store, specs, args.out, json.loads(Path(args.plan).read_text()))
        print("another update is at it" if told is None else "\n".join(f"{k}: {v}" for k, v in told.items()))
    else:
        print(f"{fetch(spark, args.store, args.kind, args.url, args.keys.split(',') if args.keys else None, args.start, args.secret)} rows")
    clean_shared(spark)


if __name__ == "__main__":
    main()
