"""What the job scripts share: arguments, session, report output."""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from outcomelens.plans.loans import LoanPreset  # noqa: E402
from outcomelens.session import build_session  # noqa: E402
from outcomelens.sources import write_csv  # noqa: E402


def arguments(description: str, *names: str, **defaults) -> argparse.Namespace:
    """Required options ``names``, optional ones with their defaults, and the platform of the loan table."""
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--platform", required=True, help="platform name as it occurs in the column names")
    for name in names:
        parser.add_argument(f"--{name}", required=True)
    for name, value in defaults.items():
        parser.add_argument(f"--{name.replace('_', '-')}", default=value, type=type(value) if value is not None else str)
    return parser.parse_args()


def start(args: argparse.Namespace, app: str) -> tuple[SparkSession, LoanPreset]:
    return build_session(app), LoanPreset(args.platform)


def save_report(df: DataFrame, folder: str, name: str) -> None:
    write_csv(df, f"{folder}/{name}")
