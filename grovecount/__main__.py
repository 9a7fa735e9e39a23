"""Run the monitoring job: ``python -m grovecount --mode TEXT --input DIR --output DIR``.

Same options as the original job's flags (job, mode, input, output,
checkpoint); there are no database credentials with defaults.
"""

from __future__ import annotations

import argparse

from grovecount.plans.modes import MODE_LABELS, JobOptions
from grovecount.session import build_session
from grovecount.streaming.job import start_job
from grovecount.streaming.sinks import jdbc_totals_sink
from grovecount.streaming.supervisor import supervise
from grovecount.streaming.timers import ROCKSDB_PROVIDER


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="grovecount", description="Orchard monitoring job on Spark.")
    ap.add_argument("--job", default=JobOptions.job, help="name of the job")
    ap.add_argument("--mode", default=JobOptions.mode, choices=sorted(MODE_LABELS), help="execution mode")
    ap.add_argument("--input", required=True, help="watched folder")
    ap.add_argument("--output", required=True, help="output folder")
    ap.add_argument("--checkpoint", required=True, help="streaming checkpoint folder")
    ap.add_argument("--images-table", default=None, help="parquet image table (see ingest_images)")
    ap.add_argument("--trigger", default=JobOptions.trigger)
    ap.add_argument("--window", default=JobOptions.window, help="window length")
    ap.add_argument("--windows", default=JobOptions.windows, choices=("tick", "clock"), help="window form")
    ap.add_argument("--no-crops", action="store_true", help="do not write the crops of accepted circles")
    ap.add_argument("--crop-pixels", action="store_true", help="also write the pixels of the crops")
    ap.add_argument("--image-parallelism", type=int, default=None, help="tasks that decode images")
    ap.add_argument("--max-files-per-trigger", type=int, default=None)
    ap.add_argument("--archive", default=None, help="move read files to this folder")
    ap.add_argument("--max-file-age", default=None, help="e.g. 7d; bounds the log of read files")
    ap.add_argument("--tolerated-failures", type=int, default=JobOptions.tolerated_failures)
    ap.add_argument("--jdbc-url", default=None, help="also add the counts to a table of this database")
    ap.add_argument("--jdbc-user", default=None)
    ap.add_argument("--jdbc-password-file", default=None, help="file that holds the password")
    ap.add_argument("--master", default=None, help="default: spark-submit's, else local[*]")
    ap.add_argument("--partitions", type=int, default=None, help="shuffle partitions; default: the configured ones")
    ap.add_argument("--available-now", action="store_true", help="process what is there, then stop")
    args = ap.parse_args(argv)

    extra = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB_PROVIDER} if args.windows == "clock" else None
    spark = build_session(args.master, args.job, args.partitions, extra)
    opts = JobOptions(mode=args.mode, job=args.job, input=args.input, output=args.output,
                      checkpoint=args.checkpoint, images_table=args.images_table, trigger=args.trigger,
                      window=args.window, windows=args.windows, write_crops=not args.no_crops,
                      crop_pixels=args.crop_pixels, image_parallelism=args.image_parallelism,
                      max_files_per_trigger=args.max_files_per_trigger, archive_dir=args.archive,
                      max_file_age=args.max_file_age, tolerated_failures=args.tolerated_failures)
    sinks = ()
    if args.jdbc_url:
        properties = {"user": args.jdbc_user} if args.jdbc_user else {}
        if args.jdbc_password_file:
            with open(args.jdbc_password_file) as f:
                properties["password"] = f.read().strip()
        sinks = (jdbc_totals_sink(args.jdbc_url, properties),)
    print(f"{args.job}: watching {opts.input} for {MODE_LABELS[opts.mode]}")
    restarts = supervise(
        lambda: start_job(spark, opts, available_now=args.available_now, extra_sinks=sinks), opts.tolerated_failures
    )
    for r in restarts:
        print(f"{args.job}: restart {r.attempt} took {r.restart_ms} ms after: {r.error}")


if __name__ == "__main__":
    main()
