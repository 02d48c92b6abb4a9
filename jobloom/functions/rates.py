"""Contract rates: tax arithmetic, thresholds, parsing of rates and IR35 status, and verdicts.

The tax functions take numbers or Columns alike: they are written over least,
greatest and a choice, so the driver's thresholds and the executors' figures come
from one definition. Both directions are monotone and piecewise linear, so the
inverse is interpolation between kinks, a ``when`` ladder instead of a search.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom import config
from jobloom.functions.matching import FLAGS, before, find_all, has
from jobloom.functions.text import one_blank, staged, strip_html


def _column(*xs) -> bool:
    return any(isinstance(x, Column) for x in xs)


def low(a, b):
    return F.least(*(x if _column(x) else F.lit(x) for x in (a, b))) if _column(a, b) else min(a, b)


def high(a, b):
    return F.greatest(*(x if _column(x) else F.lit(x) for x in (a, b))) if _column(a, b) else max(a, b)


def choose(test, a, b):
    return F.when(test, a).otherwise(b) if _column(test) else (a if test else b)


class RateModel:
    """One tax year's rules and one target salary; see ``config.RATES``."""

    def __init__(self, rules: dict | None = None, **changes):
        self.r = r = config.RATES | (rules or {}) | changes
        self.basic_band = r["basic_rate_limit"] - r["personal_allowance"]
        # Replicated: the higher band is as wide as its limit less the allowance, and starts where the basic band ends.
        self.higher_band = r["higher_rate_limit"] - r["personal_allowance"]

    def allowance(self, income):
        r = self.r
        return high(0.0, r["personal_allowance"] - high(0.0, income - r["taper_threshold"]) / 2.0)

    def income_tax(self, gross):
        r = self.r
        taxable = high(0.0, gross - self.allowance(gross))
        over = high(0.0, taxable - self.basic_band)
        return low(taxable, self.basic_band) * r["basic_rate"] + low(over, self.higher_band) * r["higher_rate"] + high(0.0, over - self.higher_band) * r["additional_rate"]

    def employee_nic(self, gross):
        r = self.r
        return high(0.0, low(gross, r["ee_upper_limit"]) - r["ee_primary"]) * r["ee_main"] + high(0.0, gross - r["ee_upper_limit"]) * r["ee_upper"]

    def employer_nic(self, gross):
        return high(0.0, gross - self.r["er_secondary"]) * self.r["er_rate"]

    def employer_pension(self, gross):
        return high(0.0, low(gross, self.r["pension_upper"]) - self.r["pension_lower"]) * self.r["pension_rate"]

    def levy(self, gross):
        return high(0.0, gross - self.r["levy_allowance"]) * self.r["levy_rate"]

    def net_salary(self, gross):
        return gross - self.income_tax(gross) - self.employee_nic(gross)

    def corporation_tax(self, profit):
        r = self.r
        p = high(0.0, profit)
        relieved = high(p * r["ct_main_rate"] - (r["ct_main_limit"] - p) * r["ct_relief"], p * r["ct_small_rate"])
        return choose(p <= r["ct_small_limit"], p * r["ct_small_rate"], choose(p >= r["ct_main_limit"], p * r["ct_main_rate"], relieved))

    def dividend_tax(self, dividends, salary):
        """Dividends lie on top of the salary; the allowance is free of tax but takes up its band."""
        r = self.r
        own = self.allowance(salary + dividends)
        salary_taxable = high(0.0, salary - own)
        left = high(0.0, salary + dividends - own) - salary_taxable
        free = low(r["dividend_allowance"], left)
        tax = 0.0
        basic = high(0.0, self.basic_band - salary_taxable)
        higher = self.higher_band - low(high(0.0, salary_taxable - self.basic_band), self.higher_band)
        for room, rate in ((basic, r["dividend_basic"]), (higher, r["dividend_higher"]), (None, r["dividend_additional"])):
            take = left if room is None else low(left, room)
            zero = low(take, free)
            tax = tax + (take - zero) * rate
            left, free = left - take, free - zero
        return tax

    def inside_assignment(self, salary):
        """What a year's assignment must be worth to pay ``salary`` through an umbrella company."""
        r = self.r
        total = salary + self.employer_nic(salary) + r["umbrella_margin"]
        if r["umbrella_levy"]:
            total = total + self.levy(salary)
        if r["umbrella_pension"]:
            total = total + self.employer_pension(salary)
        return total

    def outside(self, value) -> dict:
        """A year's contract value through a company of one's own, item by item."""
        r = self.r
        salary = low(r["company_salary"], high(0.0, value))
        nic = self.employer_nic(salary)
        profit = value - salary - nic - r["company_pension"] - r["company_fees"]
        corporation = self.corporation_tax(profit)
        dividends = high(0.0, profit - corporation)
        dividend = self.dividend_tax(dividends, salary)
        tax, own_nic = self.income_tax(salary), self.employee_nic(salary)
        return {"salary": salary, "employer_nic": nic, "profit": profit, "corporation_tax": corporation, "dividends": dividends, "income_tax": tax, "employee_nic": own_nic, "dividend_tax": dividend, "net_pay": salary - tax - own_nic + dividends - dividend}

    def inside(self, assignment) -> dict:
        """A year's assignment through an umbrella company, item by item."""
        salary = self.inside_salary(assignment)
        return {"salary": salary, "employer_nic": self.employer_nic(salary), "levy": self.levy(salary), "employer_pension": self.employer_pension(salary), "employee_nic": self.employee_nic(salary), "income_tax": self.income_tax(salary), "net_pay": self.net_salary(salary)}

    def _inverse(self, f, kinks: list[float], y):
        """x with f(x) = y for a rising f that is linear between kinks; 0 for what lies below f(0)."""
        xs = sorted({0.0, *kinks})
        xs.append(xs[-1] + 100000.0)
        ys = [f(x) for x in xs]
        line = lambda i, y: xs[i] + (y - ys[i]) * ((xs[i + 1] - xs[i]) / (ys[i + 1] - ys[i]))
        if not _column(y):
            return 0.0 if y <= ys[0] else line(min(max(bisect_right(ys, y) - 1, 0), len(xs) - 2), y)
        ladder = F.when(y <= ys[0], 0.0)
        for i in range(len(xs) - 2):
            ladder = ladder.when(y <= ys[i + 1], line(i, y))
        return ladder.otherwise(line(len(xs) - 2, y))

    def inside_salary(self, assignment):
        r = self.r
        return self._inverse(self.inside_assignment, [r["er_secondary"], r["pension_lower"], r["levy_allowance"], r["pension_upper"]], assignment)

    def salary_for_net(self, net):
        r = self.r
        gone = r["taper_threshold"] + 2 * r["personal_allowance"]
        kinks = [r["personal_allowance"], r["ee_primary"], r["basic_rate_limit"], r["ee_upper_limit"], r["taper_threshold"], gone, self.basic_band + self.higher_band, self.basic_band + self.higher_band + r["personal_allowance"]]
        # The top rate starts where taxable income passes both bands, with what is left of the allowance.
        return self._inverse(self.net_salary, kinks, net)

    def value_for_net(self, net: float) -> float:
        """The contract value outside IR35 that leaves ``net``: on the driver, by halving."""
        a, b = 0.0, max(4.0 * net, 1000.0)
        for _ in range(200):
            m = (a + b) / 2
            a, b = (m, b) if self.outside(m)["net_pay"] < net else (a, m)
        return (a + b) / 2

    def thresholds(self, days: float | None = None, salary: float | None = None) -> tuple[float, float]:
        """Day rates inside and outside IR35 that are worth ``salary``."""
        days, salary = days or self.r["days"], salary or self.r["target_salary"]
        return self.inside_assignment(salary) / days, self.value_for_net(self.net_salary(salary)) / days

    def perm_equivalent(self, day_rate, status, days: float | None = None):
        """The permanent salary that a day rate is worth under its status."""
        year = day_rate * (days or self.r["days"])
        return choose(status == "inside", self.inside_salary(year), self.salary_for_net(self.outside(year)["net_pay"]))


def with_thresholds(rows: DataFrame, days: str = "days", model: RateModel | None = None, salary: float | None = None) -> DataFrame:
    """The rows with salary, inside_rate, outside_rate: the day rates that are worth ``salary`` in a year of so many working days; null for none."""
    m = model or RateModel()
    salary = float(salary or m.r["target_salary"])
    a_day = lambda year: F.when(F.col(days) > 0, F.lit(year) / F.col(days))
    return rows.withColumns({"salary": F.lit(salary), "inside_rate": a_day(m.inside_assignment(salary)), "outside_rate": a_day(m.value_for_net(m.net_salary(salary)))})


def threshold_table(spark: SparkSession, days: list[int], model: RateModel | None = None, salaries: list[float] | None = None) -> DataFrame:
    """days, salary, inside_rate, outside_rate: the thresholds for each number of working days."""
    m = model or RateModel()
    rows = [(float(d), float(s), *m.thresholds(float(d), float(s))) for d in days for s in salaries or [m.r["target_salary"]]]
    return spark.createDataFrame(rows, "days double, salary double, inside_rate double, outside_rate double")


# Reading adverts ---------------------------------------------------------------------------

# How adverts write day rates, and the words before a figure that make it an expense.
MONEY = r"(\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|\d{3,5}(?:\.\d{1,2})?)"
DAY_UNIT = r"(?:per\s+day|/\s*day|a\s+day|per\s+diem|p/?d(?![\w/])|daily\s+rate|day\s*rate)"
EXPENSE = "(expense|allowance|mileage|parking|subsistence|travel|towards|reimburse|onboarding|equipment|per diem allowance)"
RANGE, SINGLE, PREFIX = rf"£\s*{MONEY}\s*(?:-|–|—|to)\s*£?\s*{MONEY}\s*{DAY_UNIT}", rf"£\s*{MONEY}\s*{DAY_UNIT}", rf"{DAY_UNIT}\s*(?:of|is|:)?\s*£?\s*{MONEY}"

# Phrases for IR35 status as (pattern, status, confidence).
_R, _NOT, _OF = r"ir[\s\-]*35", r"not[\s\-]+", r"[\s\-]*(?:of[\s\-]+)?(?:the[\s\-]+)?(?:scope[\s\-]+of[\s\-]+)?"
IR35_PHRASES = [
    (rf"outside{_OF}{_R}", "outside", 3),
    (rf"{_R}[\s\-]*(?:status|determination)?[\s\-]*[:\-–=][\s\-]*(?:is[\s\-]+)?outside", "outside", 3),
    (rf"outside[\s\-]*{_R}[\s\-]*(?:status|determination|role|contract|assignment|position)", "outside", 3),
    (rf"{_NOT}(?:caught|within|inside|subject[\s\-]+to|deemed|in[\s\-]+scope[\s\-]+of)[\s\-]*(?:by[\s\-]+|to[\s\-]+)?(?:the[\s\-]+)?(?:scope[\s\-]+of[\s\-]+)?{_R}", "outside", 2),
    (rf"outside[\s\-]*(?:the[\s\-]+)?(?:scope|remit)[\s\-]+of[\s\-]+{_R}", "outside", 3),
    (rf"{_R}[\s\-]*(?:status)?[\s\-]*[:\-–=][\s\-]*(?:is[\s\-]+)?no\b", "outside", 2),
    (r"limited[\s\-]+company[\s\-]+(?:contractors?[\s\-]+)?(?:welcome|acceptable|ok|considered|only|basis)", "outside", 1),
    (r"\bltd\.?[\s\-]*co(?:mpany)?[\s\-]+(?:welcome|ok|acceptable|contractors?)", "outside", 1),
    (rf"inside{_OF}{_R}", "inside", 3),
    (rf"{_R}[\s\-]*(?:status|determination)?[\s\-]*[:\-–=][\s\-]*(?:is[\s\-]+)?inside", "inside", 3),
    (rf"inside[\s\-]*{_R}[\s\-]*(?:status|determination|role|contract|assignment|position)", "inside", 3),
    (rf"{_NOT}outside{_OF}{_R}", "inside", 3),
    (rf"within[\s\-]*(?:the[\s\-]+)?scope[\s\-]+of[\s\-]+{_R}", "inside", 2),
    (rf"(?:caught|caught[\s\-]+by|subject[\s\-]+to)[\s\-]*(?:the[\s\-]+)?{_R}", "inside", 2),
    (r"deemed[\s\-]+(?:employment|employee|contract)", "inside", 2),
    (rf"{_R}[\s\-]*(?:status)?[\s\-]*[:\-–=][\s\-]*(?:is[\s\-]+)?yes\b", "inside", 2),
    (r"umbrella[\s\-]+(?:company[\s\-]+)?(?:only|basis|required|workers?|payroll|arrangement)", "inside", 1),
    (r"\bpaye[\s\-]+only\b", "inside", 1),
    (r"inside[\s\-]+of[\s\-]+scope", "inside", 1),
]
NEGATION = r"\b(not|no|never|isn'?t|arent|aren'?t|neither)\b[^.;]{0,25}$"
_SOME_IR35 = r"ir[\s\-]*35|limited[\s\-]+company|\bltd|umbrella|paye|deemed|inside[\s\-]+of"


def one_line(text: Column) -> Column:
    return one_blank(strip_html(text))


def _money(match: Column, pattern: str, group: int) -> Column:
    return F.replace(F.regexp_extract(match, FLAGS + pattern, group), F.lit(","), F.lit("")).try_cast("double")


def plausible(x: Column) -> Column:
    a, b = config.RATES["plausible"]
    return F.coalesce(x.between(a, b), F.lit(False))


def rate_figures(flat: Column) -> Column:
    """array<struct<min, max, evidence>> of the day rates in a flat text; figures in an expense's context don't count."""

    def of(pattern: str, a: int, b: int) -> Column:
        kept = F.filter(find_all(flat, pattern), lambda m: ~has(before(flat, m["start"], 45), EXPENSE))
        each = F.transform(kept, lambda m: F.struct(F.least(_money(m["match"], pattern, a), _money(m["match"], pattern, b)).alias("min"), F.greatest(_money(m["match"], pattern, a), _money(m["match"], pattern, b)).alias("max"), F.trim(m["match"]).alias("evidence")))
        return F.filter(each, lambda x: plausible(x["min"]) & plausible(x["max"]))

    none = F.array().cast("array<struct<min:double,max:double,evidence:string>>")
    return F.when(has(flat, DAY_UNIT), F.concat(of(RANGE, 1, 2), of(SINGLE, 1, 1), of(PREFIX, 1, 1))).otherwise(none)


def best_rate(found: Column) -> Column:
    """struct(min, max, evidence): the widest range, with the text of its top; null without figures."""
    top = F.array_max(F.transform(found, lambda x: x["max"]))
    best = F.get(F.filter(found, lambda x: x["max"] == top), F.lit(0))
    whole = F.struct(F.array_min(F.transform(found, lambda x: x["min"])).alias("min"), top.alias("max"), best["evidence"].alias("evidence"))
    return F.when(F.size(found) > 0, whole)


def parse_day_rates(text: Column) -> Column:
    return best_rate(rate_figures(one_line(text)))


def ir35_phrases(flat: Column) -> Column:
    """array<struct<c, s, e>>: confidence, status (turned where negated) and text of all phrases."""
    other = {"inside": "outside", "outside": "inside"}

    def of_phrase(p: str, s: str, c: int) -> Column:
        return F.transform(find_all(flat, p), lambda m: F.struct(F.lit(c).alias("c"), F.when(has(before(flat, m["start"], 30), NEGATION), other[s]).otherwise(s).alias("s"), F.trim(m["match"]).alias("e")))

    none = F.array().cast("array<struct<c:int,s:string,e:string>>")
    return F.when(has(flat, _SOME_IR35), F.concat(*(of_phrase(*x) for x in IR35_PHRASES))).otherwise(none)


def ir35_verdict(found: Column) -> Column:
    """struct(status, evidence, confidence) from the phrases found: of the most confident ones, if they agree."""
    tier = F.array_max(F.transform(found, lambda x: x["c"]))
    of = lambda s: F.filter(found, lambda x: (x["c"] == tier) & (x["s"] == s))
    inside, outside = F.get(of("inside"), F.lit(0))["e"], F.get(of("outside"), F.lit(0))["e"]
    status = F.when(inside.isNotNull() & outside.isNull(), "inside").when(outside.isNotNull() & inside.isNull(), "outside").otherwise("unknown")
    both = F.concat(F.lit("inside: "), inside, F.lit(" / outside: "), outside)
    return F.struct(status.alias("status"), F.coalesce(both, inside, outside).alias("evidence"), F.coalesce(tier, F.lit(0)).alias("confidence"))


def detect_ir35(text: Column) -> Column:
    """struct(status, evidence, confidence) of one expression; ``with_contract`` stages its parts."""
    flat = one_line(text)
    return ir35_verdict(ir35_phrases(flat))


def classify_rate(rate_min: Column, rate_max: Column, ir35: Column, model: RateModel | None = None, days: float | None = None) -> Column:
    """struct(verdict, required, assumed, reason); ``with_perm_equivalent`` adds the salary that the rate is worth."""
    m = model or RateModel()
    inside, outside = m.thresholds(days)
    best = F.coalesce(F.nullif(rate_max, F.lit(0.0)), F.nullif(rate_min, F.lit(0.0)))
    assumed = F.when(ir35.isin("inside", "outside"), ir35).otherwise("inside" if m.r["unknown_is_inside"] else "outside")
    required = F.when(assumed == "inside", inside).otherwise(outside)
    verdict = F.when(best.isNull(), "unknown").when(best >= required, "pass").when((ir35 == "unknown") & (best >= outside), "review").otherwise("fail")
    pounds = lambda x: F.concat(F.lit("£"), F.format_number(x, 0), F.lit("/day"))
    reason = (
        F.when(verdict == "unknown", "No day rate stated in the posting.")
        .when(verdict == "pass", F.concat(pounds(best), F.lit(" clears the "), pounds(required), F.lit(" needed for "), assumed, F.lit(" IR35.")))
        .when(verdict == "review", F.concat(pounds(best), F.lit(" needs the role to be OUTSIDE IR35 ("), pounds(F.lit(outside)), F.lit("); inside it would need "), pounds(F.lit(inside)), F.lit(". IR35 status is not stated — confirm before applying.")))
        .otherwise(F.concat(pounds(best), F.lit(" is below the "), pounds(required), F.lit(" needed for "), assumed, F.lit(" IR35.")))
    )
    stated = best.isNotNull()
    return F.struct(verdict.alias("verdict"), F.when(stated, required).alias("required"), F.when(stated, assumed).alias("assumed"), reason.alias("reason"))


def with_perm_equivalent(df: DataFrame, rate: Column, status: Column, out: str, model: RateModel | None = None, days: float | None = None) -> DataFrame:
    """The column ``out``: ``RateModel.perm_equivalent`` of a day rate, its parts worked out one after another."""
    m = model or RateModel()
    c = F.col
    df = staged(df, __year=rate * (days or m.r["days"]), __inside=status == "inside")
    df = staged(df, __salary=low(m.r["company_salary"], high(0.0, c("__year"))))
    df = staged(df, __profit=c("__year") - c("__salary") - m.employer_nic(c("__salary")) - m.r["company_pension"] - m.r["company_fees"])
    df = staged(df, __dividends=high(0.0, c("__profit") - m.corporation_tax(c("__profit"))))
    df = staged(df, __dividend_tax=m.dividend_tax(c("__dividends"), c("__salary")))
    df = staged(df, __net=c("__salary") - m.income_tax(c("__salary")) - m.employee_nic(c("__salary")) + c("__dividends") - c("__dividend_tax"))
    worth = F.when(c("__inside"), m.inside_salary(c("__year"))).otherwise(m.salary_for_net(c("__net")))
    df = staged(df, **{out: F.when(c("__year").isNotNull(), worth)})
    return df.drop("__year", "__inside", "__salary", "__profit", "__dividends", "__dividend_tax", "__net")


def annual_to_day(low_year: Column, high_year: Column, predicted: Column, model: RateModel | None = None) -> Column:
    """struct(min, max, source): a contract's advertised yearly salary as day rates."""
    days = (model or RateModel()).r["annualisation_days"]
    source = F.when(predicted, "estimated_by_adzuna").otherwise("derived_from_advertised_salary")
    return F.when(F.coalesce(low_year, high_year).isNotNull(), F.struct((low_year / days).alias("min"), (high_year / days).alias("max"), source.alias("source")))


def reject_reason(employment: Column, verdict: Column, source: Column, rate_min: Column, rate_max: Column, required: Column, model: RateModel | None = None) -> Column:
    """Why a contract is out of scope for its money, or null; only for a failed rate from a source that is trusted."""
    r = (model or RateModel()).r
    fires = (employment == "contract") & (verdict == "fail") & source.isin(list(r["reject_sources"]))
    text = F.concat(F.lit("contract day rate £"), F.format_number(F.coalesce(rate_max, rate_min), 0), F.lit("/day is below the £"), F.format_number(F.coalesce(required, F.lit(0.0)), 0), F.lit("/day needed"))
    return F.when(fires, text) if r["reject_below_threshold"] else F.lit(None).cast("string")
