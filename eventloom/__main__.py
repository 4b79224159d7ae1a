"""Command line: ``python -m eventloom clean|add|timeline|analyse|replies SOURCE TARGET``."""

import argparse

from eventloom.plans import jobs
from eventloom.session import get_session


def main():
    parser = argparse.ArgumentParser(prog="eventloom")
    parser.add_argument("job", choices=["clean", "add", "timeline", "analyse", "replies"])
    parser.add_argument("source")
    parser.add_argument("target")
    parser.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    parser.add_argument("--buckets", type=int, default=jobs.USER_BUCKETS,
                        help="hash users into this many folders; 0: a folder per user")
    parser.add_argument("--threshold-ms", type=float,
                        help="longest gap inside a burst (clean, add, timeline)")
    parser.add_argument("--instruction", default="Describe what this user did.",
                        help="text put before every payload (analyse)")
    parser.add_argument("--events", help="folder of the clean job that replies are held against (replies)")
    parser.add_argument("--log", help="name of the log, which is added once (add; by default its path)")
    args = parser.parse_args()
    if args.job == "replies" and args.events is None:
        parser.error("replies needs --events")
    spark = get_session(f"eventloom-{args.job}")
    chosen = {} if args.threshold_ms is None else {"threshold_ms": args.threshold_ms}
    if args.job == "analyse":
        jobs.analyse(spark, args.source, args.target, args.instruction)
    elif args.job == "add":
        jobs.add(spark, args.source, args.target, args.log or args.source, **chosen)
    elif args.job == "replies":
        jobs.replies(spark, args.source, args.events, args.target)
    else:
        job = jobs.clean if args.job == "clean" else jobs.timeline
        job(spark, args.source, args.target, fmt=args.format, buckets=args.buckets or None, **chosen)


if __name__ == "__main__":
    main()
