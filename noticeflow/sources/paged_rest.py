"""Python data source that reads paged responses, one Spark partition per job."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..session import checkpointed

SCHEMA = (
    "job_ix int, job_id string, page int, item_ix int, item map<string,string>, error string"
)

# fetch(job, page) -> (HTTP status, body text)
Fetch = Callable[[dict, int], tuple[int, str]]


class Job(InputPartition):
    def __init__(self, index: int, job: dict):
        super().__init__(index)
        self.index = index
        self.job = job


class PageError(Exception):
    pass


def paged_rest_source(fetch: Fetch, name: str = "paged_rest", sleep=time.sleep) -> type[DataSource]:
    """Data source class around a page reader; register it with ``spark.dataSource.register``.

    Options: ``jobs`` (JSON list of jobs), ``pageSize``, ``retries``, ``retrySeconds``. A job that fails, or whose body has
    another form than asked for, gives one row with ``error`` set and no item, after the items read before; other jobs go
    on. Rows leave a task as they are read. With ``pushdown`` ('true', in sessions where
    ``spark.sql.python.filterPushdown.enabled`` is set) filters on ``job_ix`` and ``job_id`` choose the jobs that are read at all.
    """

    class PagedRest(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            options = dict(self.options)
            return (FilteredReader if options.get("pushdown") == "true" else PagedReader)(fetch, sleep, options)

    return PagedRest


class PagedReader(DataSourceReader):
    def __init__(self, fetch: Fetch, sleep, options: dict):
        self.fetch = fetch
        self.sleep = sleep
        self.jobs = list(enumerate(json.loads(options["jobs"])))
        self.page_size = int(options.get("pagesize", options.get("pageSize", 999)))
        self.retries = int(options.get("retries", 3))
        self.retry_seconds = float(options.get("retryseconds", options.get("retrySeconds", 0.8)))

    def partitions(self) -> list[Job]:
        # a data source has at least one partition
        return [Job(index, job) for index, job in self.jobs] or [Job(-1, {})]

    def read(self, partition: Job) -> Iterator[tuple]:
        index, job = partition.index, partition.job
        if index < 0:
            return
        for page, items, error in self._pages(job):
            if error is not None:
                yield index, _job_id(job), None, None, None, error
                return
            for position, item in enumerate(items):
                yield index, _job_id(job), page, position, item, None

    def _pages(self, job: dict) -> Iterator[tuple[int, list, str | None]]:
        page, last = 1, 1
        while page <= last:
            try:
                body = self._body(job, page)
                items = [_texts(item) for item in _items(body.get("items"))]
                total, size = _number(body, "totalCount"), _number(body, "numOfRows") or self.page_size
            except PageError as error:
                yield page, [], str(error)
                return
            yield page, items, None
            last = max(1, -(-total // size))
            page += 1

    def _body(self, job: dict, page: int) -> dict:
        reason = ""
        for attempt in range(self.retries + 1):
            if attempt:
                self.sleep(self.retry_seconds * 2 ** (attempt - 1))
            try:
                status, text = self.fetch(job, page)
                data = json.loads(text)
            except (OSError, ValueError) as error:
                reason = str(error)
                continue
            if not isinstance(data, dict):
                raise PageError(f"the body is no object: {text[:200]}")
            upstream = _number(data, "upstreamStatus")
            if max(status, upstream) == 429 or max(status, upstream) >= 500:
                reason = data.get("error") or text
                continue
            response = _object(data.get("response"))
            if response.get("body"):
                return _object(response["body"])
            raise PageError(_object(response.get("header")).get("resultMsg") or text)
        raise PageError(reason)


class FilteredReader(PagedReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps the jobs that equalities on a job's number or id choose; yields the filters left to Spark."""
        for filter in filters:
            attribute = getattr(filter, "attribute", None)
            if not isinstance(filter, (EqualTo, In)) or attribute not in (("job_ix",), ("job_id",)):
                yield filter
                continue
            wanted = [filter.value] if isinstance(filter, EqualTo) else list(filter.value)
            by_number = attribute == ("job_ix",)
            self.jobs = [(i, job) for i, job in self.jobs if (i if by_number else _job_id(job)) in wanted]


def _job_id(job: dict) -> str:
    return json.dumps(job, ensure_ascii=False, separators=(",", ":"))


def _object(value) -> dict:
    if value is not None and not isinstance(value, dict):
        raise PageError(f"no object: {json.dumps(value, ensure_ascii=False)[:200]}")
    return value or {}


def _number(body: dict, name: str) -> int:
    try:
        return int(body.get(name) or 0)
    except (TypeError, ValueError) as error:
        raise PageError(f"{name} is no number: {body[name]}") from error


def _items(items) -> list:
    if isinstance(items, dict):
        items = items.get("item") or []
    if isinstance(items, dict):
        return [items]
    if items and not isinstance(items, list):
        raise PageError(f"items are no list: {items}")
    return items or []


def _texts(item) -> dict:
    """All values as text; nested ones as JSON."""
    return {
        key: value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
        for key, value in _object(item).items()
    }


def read_jobs(spark: SparkSession, jobs: list[dict], keep_partial: bool = True, source: str = "paged_rest", **options) -> DataFrame:
    """Landed rows of the jobs. Without ``keep_partial``, of a job that failed only the row with its error stays."""
    read = spark.read.format(source).options(jobs=json.dumps(jobs), **options).load()
    landed = checkpointed(read)  # each page is asked for once
    if keep_partial:
        return landed
    failed = landed.where("error IS NOT NULL").select("job_ix")
    return landed.where("error IS NULL").join(failed, "job_ix", "left_anti").unionByName(landed.where("error IS NOT NULL"))
