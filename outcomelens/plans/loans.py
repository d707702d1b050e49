"""Preset for a peer-to-peer loan table: its column roles, drop groups and segment reports.

Some columns of that table carry the name of the lending platform (``<platform>Score`` and the like); the name is a
parameter. Everything else here is configuration for the operators.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ColumnGroups, DropGroup
from ..functions import Band, eq, ge, le, lt, mean, outcome, share_pct
from ..operators.correlation import corr_scalars
from ..operators.ordering import dense_ranks
from ..operators.segments import bad_rate_all, bad_rate_pct, segment_report
from ..operators.temporal import quarter_change

STATUS, TARGET = "LoanStatus", "BorrowerAPR"

# Statuses, orders and band labels the reports are defined with.
NEGATIVE = ["Chargedoff", "Defaulted"]
POSITIVE = ["Completed"]
OUTCOME_NAMES = ("Good Loan", "Bad Loan", "Other / Not Finalized")
INCOME_ORDER = [
    "Not displayed", "Not employed", "$0", "$1-24,999", "$25,000-49,999", "$50,000-74,999", "$75,000-99,999", "$100,000+",
]
CREDIT_SCORE = Band((lt(600, "<600"), lt(660, "600-659"), lt(720, "660-719")), "720+")
DTI = Band((lt(0.10, "Low DTI"), lt(0.30, "Medium DTI")), "High DTI")
UTILIZATION = Band((lt(0.30, "Low Utilization"), lt(0.70, "Medium Utilization")), "High Utilization")
DELINQUENT_NOW = Band(
    (eq(0, "No Current Delinquency"), le(2, "1-2 Current Delinquencies")), "3+ Current Delinquencies")
DELINQUENT_7Y = Band((eq(0, "No 7Y Delinquency"), le(2, "1-2 in 7Y"), le(5, "3-5 in 7Y")), "5+ in 7Y")
PRIOR_LOANS = Band((eq(0, "No Previous Loan"), eq(1, "1 Previous Loan")), "2+ Previous Loans", null_as=0)
PRIOR_LATE = Band((eq(0, "No 1M+ Late Payment"),), "Has 1M+ Late Payment", null_as=0)
LOAN_SIZE = Band((lt(5000, "Small Loan"), lt(15000, "Medium Loan")), "Large Loan")
INTEREST = Band((lt(50, "Low Investor Interest"), lt(200, "Medium Investor Interest")), "High Investor Interest")
EXPECTED_LOSS = Band((lt(0.05, "Low Expected Loss"), lt(0.10, "Medium Expected Loss")), "High Expected Loss")
HISTORY = Band((lt(10, "Thin Credit History"), lt(30, "Medium Credit History")), "Strong Credit History")
TRADE_HISTORY = Band((lt(10, "Thin Credit History"), lt(30, "Medium Credit History")), "Long Credit History")
INQUIRIES = Band((eq(0, "No Recent Inquiry"), le(2, "1-2 Recent Inquiries")), "3+ Recent Inquiries")
FUNDING = Band((ge(1.0, "Fully Funded"), ge(0.8, "Mostly Funded")), "Low or Medium Funded")
APR_ERROR_BANDS = Band((
    lt(0.10, "1) [0.00, 0.10)"), lt(0.20, "2) [0.10, 0.20)"), lt(0.30, "3) [0.20, 0.30)"), lt(0.40, "4) [0.30, 0.40)"),
), "5) [0.40, +inf)")


@dataclass(frozen=True)
class LoanPreset:
    platform: str

    # Columns that carry the platform's name.
    @property
    def score(self) -> str:
        return f"{self.platform}Score"

    @property
    def rating_alpha(self) -> str:
        return f"{self.platform}Rating (Alpha)"

    @property
    def rating_numeric(self) -> str:
        return f"{self.platform}Rating (numeric)"

    @property
    def prior_loans(self) -> str:
        return f"Total{self.platform}Loans"

    @property
    def payments_billed(self) -> str:
        return f"Total{self.platform}PaymentsBilled"

    @property
    def payments_on_time(self) -> str:
        return f"OnTime{self.platform}Payments"

    @property
    def late_under_month(self) -> str:
        return f"{self.platform}PaymentsLessThanOneMonthLate"

    @property
    def late_over_month(self) -> str:
        return f"{self.platform}PaymentsOneMonthPlusLate"

    @property
    def principal_borrowed(self) -> str:
        return f"{self.platform}PrincipalBorrowed"

    @property
    def principal_outstanding(self) -> str:
        return f"{self.platform}PrincipalOutstanding"

    def declared(self) -> dict[str, str]:
        """SQL type of every column of the raw table that is not text."""
        # Columns and their types.
        types = {
            "int": (
                "ListingNumber", "LoanNumber", "LoanCurrentDaysDelinquent", "LoanFirstDefaultedCycleNumber", "LoanMonthsSinceOrigination",
                self.rating_numeric, "EmploymentStatusDuration", "CreditScoreRangeUpper", "OpenCreditLines", "OpenRevolvingAccounts",
                "PublicRecordsLast12Months", self.payments_billed, self.payments_on_time, "Recommendations", "InvestmentFromFriendsCount",
                "PublicRecordsLast10Years", "TotalCreditLinespast7years", "TotalInquiries", "CurrentCreditLines", "TradesOpenedLast6Months",
                "ListingCategory (numeric)", "ScorexChangeAtTimeOfListing", "Term", self.score, "CreditScoreRangeLower", "InquiriesLast6Months",
                "CurrentDelinquencies", "DelinquenciesLast7Years", "TotalTrades", "LoanOriginalAmount", "Investors", self.prior_loans,
                self.late_under_month, self.late_over_month,
            ),
            "double": (
                "LP_CustomerPayments", "LP_CustomerPrincipalPayments", "LP_InterestandFees", "LP_ServiceFees", "LP_CollectionFees",
                "LP_GrossPrincipalLoss", "LP_NetPrincipalLoss", "LP_NonPrincipalRecoverypayments", "StatedMonthlyIncome",
                "AvailableBankcardCredit", "RevolvingCreditBalance", "OpenRevolvingMonthlyPayment", "AmountDelinquent", self.principal_borrowed,
                self.principal_outstanding, "MonthlyLoanPayment", "InvestmentFromFriendsAmount", "BorrowerRate", "LenderYield",
                "EstimatedEffectiveYield", "EstimatedReturn", "TradesNeverDelinquent (percentage)", "PercentFunded", TARGET, "EstimatedLoss",
                "BankcardUtilization", "DebtToIncomeRatio",
            ),
            "boolean": ("CurrentlyInGroup", "IncomeVerifiable", "IsBorrowerHomeowner"),
            "timestamp": ("ClosedDate", "ListingCreationDate", "LoanOriginationDate", "DateCreditPulled", "FirstRecordedCreditLine"),
        }
        return {column: kind for kind, columns in types.items() for column in columns}

    def drop_groups(self) -> list[DropGroup]:
        """The thirteen domain-reduction stages, 81 columns down to 23."""
        # Columns and stages.
        return [
            DropGroup("initial domain filtering", (
                "ListingKey", "ListingNumber", "LoanKey", "LoanNumber", "MemberKey", "GroupKey", "LP_CustomerPayments",
                "LP_CustomerPrincipalPayments", "LP_InterestandFees", "LP_ServiceFees", "LP_CollectionFees",
                "LP_GrossPrincipalLoss", "LP_NetPrincipalLoss", "LP_NonPrincipalRecoverypayments",
                "LoanCurrentDaysDelinquent", "LoanFirstDefaultedCycleNumber", "LoanMonthsSinceOrigination",
                "CurrentlyInGroup", "ClosedDate",
            ), "identifies the record or is known only after the outcome"),
            DropGroup("internal risk metrics", (
                self.rating_alpha, self.rating_numeric, "CreditGrade"), "repeats the platform score"),
            DropGroup("income and employment", (
                "IncomeVerifiable", "EmploymentStatusDuration", "StatedMonthlyIncome"), "repeats the income range"),
            DropGroup("credit history", (
                "CreditScoreRangeUpper", "OpenCreditLines", "OpenRevolvingAccounts"), "repeats the credit score"),
            DropGroup("debt and utilization", (
                "AvailableBankcardCredit", "RevolvingCreditBalance", "OpenRevolvingMonthlyPayment",
            ), "repeats the card utilization"),
            DropGroup("delinquency", ("AmountDelinquent", "PublicRecordsLast12Months"), "weaker delinquency signal"),
            DropGroup("prior borrowing", (
                self.payments_billed, self.payments_on_time, self.principal_borrowed, self.principal_outstanding,
            ), "describes volume, overlaps with the prior loans"),
            DropGroup("loan structure", (
                "MonthlyLoanPayment", "Recommendations", "InvestmentFromFriendsCount", "InvestmentFromFriendsAmount",
            ), "derived or rarely filled"),
            DropGroup("pricing components", (
                "BorrowerRate", "LenderYield", "EstimatedEffectiveYield", "EstimatedReturn"), "leaks the price"),
            DropGroup("credit capacity", (
                "TradesNeverDelinquent (percentage)", "PublicRecordsLast10Years", "TotalCreditLinespast7years",
            ), "overlaps with the trade history"),
            DropGroup("borrower profile", ("BorrowerState", "Occupation", "EmploymentStatus"), "weak profile signal"),
            DropGroup("credit activity", (
                "TotalInquiries", "CurrentCreditLines", "TradesOpenedLast6Months"), "overlaps with the recent inquiries"),
            DropGroup("listing information", (
                "ListingCategory (numeric)", "PercentFunded", "LoanOriginationQuarter", "ScorexChangeAtTimeOfListing",
            ), "descriptive or unstable"),
        ]

    def manual_reasons(self) -> dict[str, str]:
        """Columns removed by hand before the correlation step, where they are still present."""
        after = "known only after the loan was granted"
        names = next(g for g in self.drop_groups() if g.stage == "initial domain filtering").columns
        return {
            **{c: after for c in names if c.startswith("LP_")},
            "Investors": "funding signal without credit-risk value",
            "Recommendations": "social signal without credit-risk value",
            "BorrowerRate": "the price under another name",
        }

    def column_groups(self) -> ColumnGroups:
        # Columns and their roles.
        return ColumnGroups(
            status=STATUS, target=TARGET,
            numeric=(
                "Term", "EstimatedLoss", self.score, "CreditScoreRangeLower", "InquiriesLast6Months",
                "CurrentDelinquencies", "DelinquenciesLast7Years", "BankcardUtilization", "TotalTrades",
                "DebtToIncomeRatio", self.prior_loans, self.late_under_month, self.late_over_month,
                "LoanOriginalAmount", "Investors",
            ),
            categorical=("IncomeRange", "EmploymentStatus"),
            boolean=("IsBorrowerHomeowner",),
            dates=("ListingCreationDate", "LoanOriginationDate", "DateCreditPulled", "FirstRecordedCreditLine"),
        )

    @property
    def date_parts(self) -> dict[str, str]:
        return {"listing": "ListingCreationDate", "loan_origination": "LoanOriginationDate"}

    @property
    def day_spans(self) -> dict[str, tuple[str, str]]:
        return {
            "credit_history_days": ("LoanOriginationDate", "FirstRecordedCreditLine"),
            "credit_pull_to_origination_days": ("LoanOriginationDate", "DateCreditPulled"),
        }

    def reports(self, df: DataFrame) -> dict[str, DataFrame]:
        """Every segment report and correlation check on the raw table, lazily."""
        apr = {"avg_apr": mean(TARGET, 4)}
        rate = {"bad_loan_rate_percent": bad_rate_pct(outcome(STATUS, NEGATIVE, POSITIVE))}

        def report(keys, measures, require, min_rows=0, correlations=None):
            return segment_report(df, keys, measures, require, min_rows, "total_loans", correlations)

        def ranked(keys, *args, price="apr_rank", **kwargs):
            return dense_ranks(report(keys, *args, **kwargs), {
                price: F.col("avg_apr"),
                "default_risk_rank": F.coalesce("bad_loan_rate_percent", F.lit(-1.0)),
            }).orderBy(price, "default_risk_rank")

        owner = F.when(F.col("IsBorrowerHomeowner"), "Homeowner").otherwise("Non-Homeowner")
        now = {"delinquency_group": (DELINQUENT_NOW, "CurrentDelinquencies")}
        score = {self.score: self.score}
        income = {"IncomeRange": "IncomeRange", "EmploymentStatus": "EmploymentStatus"}
        credit = {"credit_score_group": (CREDIT_SCORE, "CreditScoreRangeLower"), "dti_group": (DTI, "DebtToIncomeRatio")}
        quarter = {
            "orig_year": F.year("LoanOriginationDate").cast("long"),
            "orig_quarter": F.quarter("LoanOriginationDate").cast("long"),
            "listing_category": F.col("`ListingCategory (numeric)`"), "funding_group": (FUNDING, "PercentFunded"),
        }
        quarterly = quarter_change(
            report(quarter, {
                **apr, **rate,
                "avg_percent_funded": mean("PercentFunded", 4), "avg_investors": mean("Investors"),
                "avg_score_change": mean("ScorexChangeAtTimeOfListing"),
                "score_decrease_percent": share_pct(F.col("ScorexChangeAtTimeOfListing") < 0),
            }, ["LoanOriginationDate", "ListingCategory (numeric)", "PercentFunded", TARGET], 100),
            "avg_apr", ["listing_category", "funding_group"], "orig_year", "orig_quarter",
        ).withColumnsRenamed({
            "prev_avg_apr": "prev_quarter_avg_apr", "avg_apr_change": "apr_change_vs_prev_quarter"})
        return {
            "internal_risk": report(score, apr | rate, [self.score]).orderBy(self.score),
            "income_employment": report(income, apr | rate, list(income), 100).orderBy(*income),
            "credit_score_dti": report(
                credit, apr | rate, ["CreditScoreRangeLower", "DebtToIncomeRatio"], 100).orderBy(*credit),
            "utilization": report(
                {"utilization_group": (UTILIZATION, "BankcardUtilization")}, apr | rate, ["BankcardUtilization"],
            ).orderBy(F.desc("avg_apr")),
            "delinquency": ranked({
                "current_delinquency_group": (DELINQUENT_NOW, "CurrentDelinquencies"),
                "delinquency_history_group": (DELINQUENT_7Y, "DelinquenciesLast7Years"),
            }, {
                **apr, **rate,
                "avg_amount_delinquent": mean("AmountDelinquent", null_as=0),
                "avg_public_records_10y": mean("PublicRecordsLast10Years", null_as=0),
                "avg_public_records_12m": mean("PublicRecordsLast12Months", null_as=0),
            }, ["CurrentDelinquencies", "DelinquenciesLast7Years", TARGET], 100, price="apr_risk_rank"),
            "prior_borrowing": ranked({
                "prior_loan_history": (PRIOR_LOANS, self.prior_loans),
                "late_payment_group": (PRIOR_LATE, self.late_over_month),
            }, {
                **apr, **rate,
                "avg_on_time_payments": mean(self.payments_on_time, null_as=0),
                "avg_payments_billed": mean(self.payments_billed, null_as=0),
                "avg_principal_borrowed": mean(self.principal_borrowed, null_as=0),
                "avg_principal_outstanding": mean(self.principal_outstanding, null_as=0),
            }, [TARGET], 100, price="apr_risk_rank"),
            "loan_structure": ranked({
                "loan_size_group": (LOAN_SIZE, "LoanOriginalAmount"), "Term": "Term",
                "investor_group": (INTEREST, "Investors"),
            }, {
                **apr, **rate,
                "avg_monthly_payment": mean("MonthlyLoanPayment"), "avg_percent_funded": mean("PercentFunded", 4),
                "avg_recommendations": mean("Recommendations"),
                "avg_friend_invest_count": mean("InvestmentFromFriendsCount"),
                "avg_friend_invest_amount": mean("InvestmentFromFriendsAmount"),
            }, ["LoanOriginalAmount", "Term", "Investors", TARGET], 100),
            "expected_loss": ranked({"expected_loss_group": (EXPECTED_LOSS, "EstimatedLoss")}, {
                **apr, **rate,
                "avg_estimated_loss": mean("EstimatedLoss", 4), "avg_borrower_rate": mean("BorrowerRate", 4),
                "avg_lender_yield": mean("LenderYield", 4), "avg_effective_yield": mean("EstimatedEffectiveYield", 4),
                "avg_estimated_return": mean("EstimatedReturn", 4),
            }, ["EstimatedLoss", TARGET], correlations={
                "corr_apr_borrower_rate": (TARGET, "BorrowerRate"), "corr_apr_lender_yield": (TARGET, "LenderYield"),
                "corr_apr_effective_yield": (TARGET, "EstimatedEffectiveYield"),
                "corr_apr_estimated_return": (TARGET, "EstimatedReturn"),
                "corr_loss_return": ("EstimatedLoss", "EstimatedReturn"),
            }),
            "credit_history_all_rows": report(
                {**now, "credit_history_group": (HISTORY, "TotalTrades")},
                {**apr, "bad_loan_rate": bad_rate_all(STATUS, NEGATIVE)},
                ["CurrentDelinquencies", "TotalTrades", TARGET, STATUS],
            ).orderBy(F.desc("bad_loan_rate"), F.desc("avg_apr")),
            "credit_history_corr": corr_scalars(df, {
                "corr_credit_history": ("CurrentCreditLines", "TotalCreditLinespast7years"),
                "corr_credit_trade": ("CurrentCreditLines", "TotalTrades"),
                "corr_trade_quality": ("TotalTrades", "TradesNeverDelinquent (percentage)"),
            }),
            "homeowner": report({"homeowner_group": owner}, apr, ["IsBorrowerHomeowner"]).orderBy(F.desc("avg_apr")),
            "employment": report(
                {"EmploymentStatus": "EmploymentStatus"}, apr, ["EmploymentStatus"], 501).orderBy(F.desc("avg_apr")),
            "homeowner_employment": report(
                {"homeowner_group": owner, "EmploymentStatus": "EmploymentStatus"}, apr,
                ["IsBorrowerHomeowner", "EmploymentStatus"], 201).orderBy(F.desc("total_loans")),
            "top_states": report({"BorrowerState": "BorrowerState"}, apr, ["BorrowerState"], 1001).orderBy(
                F.desc("total_loans"), "BorrowerState").limit(15),
            "top_occupations": report({"Occupation": "Occupation"}, apr, ["Occupation"], 501).orderBy(
                F.desc("total_loans"), "Occupation").limit(15),
            "credit_activity": ranked({
                "recent_inquiry_group": (INQUIRIES, "InquiriesLast6Months"),
                "trade_history_group": (TRADE_HISTORY, "TotalTrades"),
            }, {
                **apr, **rate,
                "avg_total_inquiries": mean("TotalInquiries"),
                "avg_recent_trades_opened": mean("TradesOpenedLast6Months"),
                "avg_current_credit_lines": mean("CurrentCreditLines"),
            }, ["InquiriesLast6Months", "TotalTrades", TARGET], 100, correlations={
                "corr_recent_total_inquiries": ("InquiriesLast6Months", "TotalInquiries"),
                "corr_current_lines_total_trades": ("CurrentCreditLines", "TotalTrades"),
                "corr_recent_trades_inquiries": ("TradesOpenedLast6Months", "InquiriesLast6Months"),
            }),
            "quarterly": dense_ranks(
                quarterly, {"quarterly_apr_rank": F.col("avg_apr")}, within=["orig_year", "orig_quarter"],
            ).orderBy("orig_year", "orig_quarter", "quarterly_apr_rank"),
            "funding_corr": corr_scalars(
                df.filter(F.col("PercentFunded").isNotNull() & F.col("Investors").isNotNull()),
                {"corr_percent_funded_investors": ("PercentFunded", "Investors")}),
        }
