"""The loan jobs end to end on a made-up loan table: CSV to scored stream."""

import csv
import os
import random
import runpy
import sys
import time

import duckdb
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from outcomelens.operators.profiling import missing_summary
from outcomelens.plans.loans import LoanPreset

JOBS = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "jobs")
P = LoanPreset("Acme")
KEPT = [P.column_groups().status, P.column_groups().target, *P.column_groups().numeric,
        "IncomeRange", "IsBorrowerHomeowner", *P.column_groups().dates]
INTS = ["CurrentDelinquencies", "DelinquenciesLast7Years", P.prior_loans, P.late_over_month, P.late_under_month,
        "InquiriesLast6Months", "TotalInquiries", "TradesOpenedLast6Months", "PublicRecordsLast12Months",
        "PublicRecordsLast10Years", "ScorexChangeAtTimeOfListing", "Recommendations", "ListingCategory (numeric)"]


def loan(draw, i):
    risk = draw.random()
    row = {c: f"{draw.random():.4f}" for g in P.drop_groups() for c in g.columns}
    row |= {c: f"{draw.random():.4f}" for c in KEPT}
    kinds = P.declared()
    row |= {c: str(draw.randrange(1000)) for c in row if kinds.get(c) == "int"}
    row |= {c: draw.choice(["True", "False"]) for c in row if kinds.get(c) == "boolean"}
    row |= {c: "2014-03-04 10:11:12.130000000" for c in row if kinds.get(c) == "timestamp"}
    row |= {c: str(draw.choice([0, 0, 1, 2, 4, 9])) for c in INTS}
    apr = round(0.05 + 0.3 * risk + draw.gauss(0, 0.01), 5)
    status = draw.choice(["Current", "Past Due"]) if draw.random() < 0.3 else (
        draw.choice(["Chargedoff", "Defaulted"]) if risk + draw.gauss(0, 0.1) > 0.6 else "Completed")
    row |= {
        "ListingKey": f"L{i}", "LoanStatus": status, "BorrowerAPR": str(apr), "BorrowerRate": str(apr - 0.01),
        "EstimatedLoss": f"{risk * 0.2:.4f}", P.score: str(11 - int(risk * 10)), "Term": draw.choice(["12", "36", "60"]),
        "CreditScoreRangeLower": str(int(800 - 250 * risk) // 20 * 20), "TotalTrades": str(draw.randint(1, 60)),
        "LoanOriginalAmount": str(draw.randint(1, 30) * 1000), "Investors": str(draw.randint(1, 400)),
        "PercentFunded": draw.choice(["1.0", "0.9", "0.5"]),
        "IncomeRange": draw.choice(["$1-24,999", "$25,000-49,999", "$100,000+"]),
        "EmploymentStatus": draw.choice(["Employed", "Self-employed"]), "BorrowerState": draw.choice(["CA", "TX"]),
        "Occupation": draw.choice(["Nurse", "Pilot"]), "IsBorrowerHomeowner": draw.choice(["True", "False"]),
        "ListingCreationDate": f"201{i % 4}-0{i % 9 + 1}-05", "LoanOriginationDate": f"201{i % 4}-0{i % 9 + 1}-20",
        "DateCreditPulled": f"201{i % 4}-0{i % 9 + 1}-04", "FirstRecordedCreditLine": f"19{80 + i % 20}-01-01",
        "MonthlyLoanPayment": f"{draw.random() * 100:.2f}",
    }
    if i % 20:  # rarely filled, so sparse
        row |= {P.prior_loans: "", P.late_over_month: "", P.late_under_month: ""}
    if i % 7 == 0:
        row |= {"DebtToIncomeRatio": "", "BankcardUtilization": ""}
    return row


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    folder = tmp_path_factory.mktemp("loans")
    draw = random.Random(1)
    rows = [loan(draw, i) for i in range(2600)]
    with open(folder / "loans.csv", "w", newline="") as out:
        writer = csv.DictWriter(out, list(rows[0]))
        writer.writeheader()
        writer.writerows([*rows, *[r | {"ListingKey": "again", **{c: r[c] for c in KEPT}} for r in rows[:100]]])
    return folder


@pytest.fixture(scope="module")
def run(spark, folder):
    """Run a job script in this process, with the test session kept open."""
    patch = pytest.MonkeyPatch()
    patch.setattr(SparkSession, "stop", lambda self: None)
    patch.syspath_prepend(JOBS)

    def run(job, **options):
        args = [x for name, value in options.items() for x in (f"--{name.replace('_', '-')}", str(value))]
        patch.setattr(sys, "argv", [job, "--platform", "Acme", *args])
        started = time.time()
        runpy.run_path(os.path.join(JOBS, f"{job}.py"), run_name="__main__")
        print(f"{job}: {time.time() - started:.1f}s")

    yield run
    patch.undo()


def report(spark, folder, job, name):
    return spark.read.csv(f"{folder}/reports/{job}/{name}", header=True, inferSchema=True)


def test_jobs_from_csv_to_scored_stream(spark, folder, run):
    at = str(folder)
    run("check_table", csv=f"{at}/loans.csv", table=f"{at}/raw", reports=f"{at}/reports/check")
    shape = report(spark, at, "check", "shape").first()
    assert (shape["row_count"], shape["column_count"], shape["accepted"]) == (2700, 81, False)

    assert report(spark, at, "check", "fields").agg(F.sum("failed")).first()[0] == 0 and not os.path.exists(f"{at}/raw-quarantine")
    assert report(spark, at, "check", "fields").filter("present IS NOT NULL").count() == 1 + len(P.declared())
    assert dict(spark.read.parquet(f"{at}/raw").dtypes) | P.declared() == dict(spark.read.parquet(f"{at}/raw").dtypes)

    run("segments", table=f"{at}/raw", reports=f"{at}/reports/segments")
    assert len(os.listdir(f"{at}/reports/segments")) == 18

    run("reduce", table=f"{at}/raw", reduced=f"{at}/reduced", reports=f"{at}/reports/reduce")
    ledger = report(spark, at, "reduce", "domain_ledger")
    assert ledger.filter("dropped").count() == 58 and ledger.agg(F.min("columns_left")).first()[0] == 23
    stages = {r["feature"]: r["stage"] for r in report(spark, at, "reduce", "removal_ledger").collect()}
    assert stages.pop("Investors") == "manual"
    assert {f for f, s in stages.items() if s == "sparse"} == {P.prior_loans, P.late_under_month, P.late_over_month}
    assert len(spark.read.parquet(f"{at}/reduced").columns) == 23 - 1 - len(stages)

    run("prepare", reduced=f"{at}/reduced", classification=f"{at}/cls", regression=f"{at}/reg",
        reports=f"{at}/reports/prepare")
    assert tuple(report(spark, at, "prepare", "duplicates").first()) == (2700, 2600)
    progress = {(r["stage"], r["metric"]): r["value"] for r in report(spark, at, "prepare", "progress").collect()}
    cls = spark.read.parquet(f"{at}/cls")
    assert progress["read", "rows"] == 2700 and progress["distinct", "rows"] == 2600 and progress["classification", "rows"] == cls.count()
    assert progress["classification", "test"] == cls.filter("part = 'test'").count() > 0
    reduced = {(r["stage"], r["metric"]): r["value"] for r in report(spark, at, "reduce", "progress").collect()}
    assert reduced["reduced", "rows"] == 2700 and reduced["domain", "columns"] == 23
    assert {"label", "credit_history_days", "listing_month"} <= set(cls.columns)
    assert not {"LoanStatus", "BorrowerAPR", "DateCreditPulled"} & set(cls.columns)
    assert all(r["missing_count"] == 0 for r in missing_summary(cls).collect())

    small = dict(lr_iter=10, trees=5, forest_depth=4, boost_iter=4, boost_depth=3, score_trees=5)
    run("train_classifier", classification=f"{at}/cls", model=f"{at}/model", stream=f"{at}/stream",
        reports=f"{at}/reports/cls", **small)
    metrics = report(spark, at, "cls", "metrics").collect()
    assert len(metrics) == 3 and all(m["roc_auc"] > 0.8 for m in metrics)
    assert report(spark, at, "cls", "best_model").first()["model"] == metrics[0]["model"]

    run("train_regressor", regression=f"{at}/reg", model=f"{at}/price_model", reports=f"{at}/reports/reg", **small)
    assert report(spark, at, "reg", "best_model").first()["r2"] > 0.5
    test_rows = spark.read.parquet(f"{at}/reg/part=test").count()
    assert report(spark, at, "reg", "error_by_band").agg(F.sum("n")).first()[0] == test_rows
    assert report(spark, at, "reg", "prediction_sample").count() == 200

    run("publish", records=f"{at}/stream/parquet", format="text", path=f"{at}/topic")
    run("score_stream", schema_from=f"{at}/stream/parquet", model=f"{at}/model", out=f"{at}/scored",
        quarantine=f"{at}/bad", checkpoint=f"{at}/cp", format="text", path=f"{at}/topic", every="")
    scored = spark.read.parquet(f"{at}/scored")
    assert scored.count() == spark.read.parquet(f"{at}/stream/parquet").count() > 0
    assert {r[0] for r in scored.select("prediction_label").distinct().collect()} <= {"Good", "Bad"}
    assert spark.read.parquet(f"{at}/bad").count() == 0


def test_check_table_quarantines_and_accounts(spark, folder, run, tmp_path):
    draw = random.Random(9)
    rows = [loan(draw, i) for i in range(60)]
    rows[3]["Term"], rows[4]["Term"], rows[4]["ClosedDate"], rows[5]["IsBorrowerHomeowner"] = "many", "36.5", "soon", "perhaps"
    with open(tmp_path / "loans.csv", "w", newline="") as out:
        writer = csv.DictWriter(out, list(rows[0]))
        writer.writeheader()
        writer.writerows(rows)
        out.write("too,short\n")
    run("check_table", csv=f"{tmp_path}/loans.csv", table=f"{tmp_path}/raw", reports=f"{tmp_path}/reports/check")
    fields = {r["field"]: (r["present"], r["failed"]) for r in report(spark, tmp_path, "check", "fields").collect()}
    assert fields["Term"] == (58, 2) and fields["(record)"] == (60, 1) and fields["IsBorrowerHomeowner"] == (59, 1) and fields["ClosedDate"] == (59, 1)
    assert spark.read.parquet(f"{tmp_path}/raw").count() == 57 and spark.read.parquet(f"{tmp_path}/raw-quarantine").count() == 4
    progress = {(r["stage"], r["metric"]): r["value"] for r in report(spark, tmp_path, "check", "progress").collect()}
    assert progress == {("read", "rows"): 61, ("read", "bad_rows"): 4, ("read", "bad_records"): 1, ("kept", "rows"): 57}


def band(column, *cuts):
    """First cut that holds names the band; the last entry takes the rest."""
    *tests, rest = cuts
    return "CASE " + " ".join(f"WHEN {column} {test} THEN '{label}'" for test, label in tests) + f" ELSE '{rest}' END"


APR = "round(avg(BorrowerAPR), 4)"
RATE = "round(avg(CASE LoanStatus WHEN 'Completed' THEN 0 WHEN 'Chargedoff' THEN 1 WHEN 'Defaulted' THEN 1 END) * 100, 2)"
OWNER = "if(IsBorrowerHomeowner, 'Homeowner', 'Non-Homeowner')"


def avg(column, digits=2):
    return f'round(avg("{column}"), {digits})'


def avg0(column):
    return f'round(sum("{column}") / count(*), 2)'


def sql(keys, values, needs, least=1, ranks=False, pairs=(), top=None):
    """Report over ``loans``: keys, row count, values; ranks count the distinct higher values; correlations are over all rows."""
    names = [f"k{i}" for i in range(len(keys))]
    where = " AND ".join(f'"{c}" IS NOT NULL' for c in needs) or "TRUE"
    columns = [f"{k} AS {n}" for k, n in zip(keys, names)] + ["count(*) AS total"] + [f"{v} AS v{i}" for i, v in enumerate(values)]
    report = f"WITH g AS (SELECT {', '.join(columns)} FROM loans WHERE {where} GROUP BY {', '.join(names)} HAVING count(*) >= {least}) SELECT g.*"
    for a, b in pairs:
        report += f', (SELECT round(corr("{a}", "{b}"), 4) FROM loans)'
    if ranks:
        for value in ("{}.v0", "coalesce({}.v1, -1)"):
            report += f", (SELECT count(DISTINCT {value.format('o')}) + 1 FROM g o WHERE {value.format('o')} > {value.format('g')})"
    return report + " FROM g" + (f" ORDER BY total DESC, k0 LIMIT {top}" if top else "")


INQUIRY = band("InquiriesLast6Months", ("= 0", "No Recent Inquiry"), ("<= 2", "1-2 Recent Inquiries"), "3+ Recent Inquiries")
CURRENT = band("CurrentDelinquencies", ("= 0", "No Current Delinquency"), ("<= 2", "1-2 Current Delinquencies"), "3+ Current Delinquencies")
FUNDED = band("PercentFunded", (">= 1.0", "Fully Funded"), (">= 0.8", "Mostly Funded"), "Low or Medium Funded")
SQL = {
    "internal_risk": sql(["AcmeScore"], [APR, RATE], ["AcmeScore"]),
    "income_employment": sql(["IncomeRange", "EmploymentStatus"], [APR, RATE], ["IncomeRange", "EmploymentStatus"], 100),
    "credit_score_dti": sql([
        band("CreditScoreRangeLower", ("< 600", "<600"), ("< 660", "600-659"), ("< 720", "660-719"), "720+"),
        band("DebtToIncomeRatio", ("< 0.1", "Low DTI"), ("< 0.3", "Medium DTI"), "High DTI"),
    ], [APR, RATE], ["CreditScoreRangeLower", "DebtToIncomeRatio"], 100),
    "utilization": sql([band("BankcardUtilization", ("< 0.3", "Low Utilization"), ("< 0.7", "Medium Utilization"), "High Utilization")],
                       [APR, RATE], ["BankcardUtilization"]),
    "delinquency": sql([
        CURRENT, band("DelinquenciesLast7Years", ("= 0", "No 7Y Delinquency"), ("<= 2", "1-2 in 7Y"), ("<= 5", "3-5 in 7Y"), "5+ in 7Y"),
    ], [APR, RATE, avg0("AmountDelinquent"), avg0("PublicRecordsLast10Years"), avg0("PublicRecordsLast12Months")],
        ["CurrentDelinquencies", "DelinquenciesLast7Years", "BorrowerAPR"], 100, ranks=True),
    "prior_borrowing": sql([
        "CASE TotalAcmeLoans WHEN 1 THEN '1 Previous Loan' ELSE if(TotalAcmeLoans > 1, '2+ Previous Loans', 'No Previous Loan') END",
        "if(AcmePaymentsOneMonthPlusLate > 0, 'Has 1M+ Late Payment', 'No 1M+ Late Payment')",
    ], [APR, RATE, avg0("OnTimeAcmePayments"), avg0("TotalAcmePaymentsBilled"), avg0("AcmePrincipalBorrowed"), avg0("AcmePrincipalOutstanding")],
        ["BorrowerAPR"], 100, ranks=True),
    "loan_structure": sql([
        band("LoanOriginalAmount", ("< 5000", "Small Loan"), ("< 15000", "Medium Loan"), "Large Loan"), "Term",
        band("Investors", ("< 50", "Low Investor Interest"), ("< 200", "Medium Investor Interest"), "High Investor Interest"),
    ], [APR, RATE, avg("MonthlyLoanPayment"), avg("PercentFunded", 4), avg("Recommendations"), avg("InvestmentFromFriendsCount"),
        avg("InvestmentFromFriendsAmount")], ["LoanOriginalAmount", "Term", "Investors", "BorrowerAPR"], 100, ranks=True),
    "expected_loss": sql(
        [band("EstimatedLoss", ("< 0.05", "Low Expected Loss"), ("< 0.1", "Medium Expected Loss"), "High Expected Loss")],
        [APR, RATE, *[avg(c, 4) for c in ("EstimatedLoss", "BorrowerRate", "LenderYield", "EstimatedEffectiveYield", "EstimatedReturn")]],
        ["EstimatedLoss", "BorrowerAPR"], ranks=True, pairs=[
            ("BorrowerAPR", "BorrowerRate"), ("BorrowerAPR", "LenderYield"), ("BorrowerAPR", "EstimatedEffectiveYield"), ("BorrowerAPR", "EstimatedReturn"),
            ("EstimatedLoss", "EstimatedReturn")]),
    "credit_history_all_rows": sql([
        CURRENT, band("TotalTrades", ("< 10", "Thin Credit History"), ("< 30", "Medium Credit History"), "Strong Credit History"),
    ], [APR, "round(count(*) FILTER (WHERE LoanStatus IN ('Chargedoff', 'Defaulted')) / count(*), 4)"],
        ["CurrentDelinquencies", "TotalTrades", "BorrowerAPR", "LoanStatus"]),
    "credit_history_corr": """SELECT round(corr(CurrentCreditLines, TotalCreditLinespast7years), 4), round(corr(CurrentCreditLines, TotalTrades), 4),
        round(corr(TotalTrades, "TradesNeverDelinquent (percentage)"), 4) FROM loans""",
    "homeowner": sql([OWNER], [APR], ["IsBorrowerHomeowner"]),
    "employment": sql(["EmploymentStatus"], [APR], ["EmploymentStatus"], 501),
    "homeowner_employment": sql([OWNER, "EmploymentStatus"], [APR], ["IsBorrowerHomeowner", "EmploymentStatus"], 201),
    "top_states": sql(["BorrowerState"], [APR], ["BorrowerState"], 1001, top=15),
    "top_occupations": sql(["Occupation"], [APR], ["Occupation"], 501, top=15),
    "credit_activity": sql([
        INQUIRY, band("TotalTrades", ("< 10", "Thin Credit History"), ("< 30", "Medium Credit History"), "Long Credit History"),
    ], [APR, RATE, avg("TotalInquiries"), avg("TradesOpenedLast6Months"), avg("CurrentCreditLines")],
        ["InquiriesLast6Months", "TotalTrades", "BorrowerAPR"], 100, ranks=True, pairs=[
            ("InquiriesLast6Months", "TotalInquiries"), ("CurrentCreditLines", "TotalTrades"), ("TradesOpenedLast6Months", "InquiriesLast6Months")]),
    "quarterly": f"""
        WITH g AS (
            SELECT year(LoanOriginationDate) AS y, quarter(LoanOriginationDate) AS q, "ListingCategory (numeric)" AS c, {FUNDED} AS f, count(*) AS n,
                {APR} AS apr, {RATE} AS rate, {avg("PercentFunded", 4)} AS m1, {avg("Investors")} AS m2, {avg("ScorexChangeAtTimeOfListing")} AS m3,
                round(count(*) FILTER (WHERE ScorexChangeAtTimeOfListing < 0) / count(*) * 100, 2) AS m4
            FROM loans WHERE LoanOriginationDate IS NOT NULL AND "ListingCategory (numeric)" IS NOT NULL AND PercentFunded IS NOT NULL
                AND BorrowerAPR IS NOT NULL GROUP BY y, q, c, f HAVING count(*) >= 100),
        p AS (SELECT g.*, (SELECT max_by(o.apr, o.y * 4 + o.q) FROM g o WHERE o.c = g.c AND o.f = g.f AND o.y * 4 + o.q < g.y * 4 + g.q) AS before FROM g)
        SELECT p.*, round(apr - before, 4), (SELECT count(DISTINCT o.apr) + 1 FROM g o WHERE o.y = p.y AND o.q = p.q AND o.apr > p.apr) FROM p""",
    "funding_corr": "SELECT round(corr(PercentFunded, Investors), 4) FROM loans",
}


def test_reports_match_sql(spark, folder):
    table = spark.read.csv(f"{folder}/loans.csv", header=True, inferSchema=True)
    reports = P.reports(table)
    assert set(SQL) == set(reports) and len(SQL) == 18
    con = duckdb.connect()
    con.execute(f"CREATE VIEW loans AS SELECT * FROM read_csv('{folder}/loans.csv', header = true)")

    def plain(rows):
        return sorted(([float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r] for r in rows), key=repr)

    empty = set()
    for name, text in SQL.items():
        got, want = plain(reports[name].collect()), plain(con.execute(text).fetchall())
        assert got == want, name
        empty |= {name} if not got else set()
    assert empty <= {"quarterly"}


def test_quarterly_report_on_few_categories(spark, folder):
    table = spark.read.csv(f"{folder}/loans.csv", header=True, inferSchema=True)
    narrow = table.withColumn("ListingCategory (numeric)", F.lit(1)).withColumn("PercentFunded", F.when(F.col("Term") == 60, 1.0).otherwise(0.9))
    con = duckdb.connect()
    con.register("t", narrow.toPandas())
    con.execute("CREATE VIEW loans AS SELECT * FROM t")
    got = [[str(x) for x in r] for r in P.reports(narrow)["quarterly"].collect()]
    want = [[str(x) for x in r] for r in con.execute(SQL["quarterly"]).fetchall()]
    assert len(got) > 10 and len({r[11] for r in got}) > 5
    assert sorted(r[:3] + r[4:6] + r[13:] for r in got) == sorted(r[:3] + r[4:6] + r[13:] for r in want)


def test_drop_groups_cover_the_raw_table():
    assert sum(len(g.columns) for g in P.drop_groups()) == 58
    assert len({c for g in P.drop_groups() for c in g.columns} | {c for c in KEPT if c != "EmploymentStatus"}) == 81
    with pytest.raises(AttributeError):
        P.unknown_role
