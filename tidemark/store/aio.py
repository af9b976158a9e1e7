"""The store for coroutines: threads wait for Spark's jobs, the event loop doesn't."""

from __future__ import annotations

import asyncio
import concurrent.futures
from functools import partial

from .catalog import Collection, Store, store

THREADS = 4


class _Threads:
    def __init__(self, executor: concurrent.futures.Executor | None):
        self._own = executor is None
        self.executor = executor or concurrent.futures.ThreadPoolExecutor(THREADS)

    async def _run(self, func, *args, **kw):
        return await asyncio.get_running_loop().run_in_executor(self.executor, partial(func, *args, **kw))

    def close(self) -> None:
        if self._own:
            self.executor.shutdown(wait=True)


class AsyncCollection(_Threads):
    def __init__(self, collection: Collection, executor: concurrent.futures.Executor | None = None):
        super().__init__(executor)
        self.collection = collection

    async def write(self, item: str, data, **kw) -> None:
        await self._run(self.collection.write, item, data, **kw)

    async def read(self, item: str, **kw):
        return await self._run(lambda: self.collection.item(item, **kw).to_pandas())

    async def append(self, item: str, data, **kw) -> None:
        await self._run(self.collection.append, item, data, **kw)

    async def delete(self, item: str, **kw) -> bool:
        return await self._run(self.collection.delete_item, item, **kw)

    async def list_items(self, **kw) -> set[str]:
        return await self._run(self.collection.list_items, **kw)

    async def write_batch(self, items_data: dict, **kw) -> None:
        await asyncio.gather(*(self.write(item, data, **kw) for item, data in items_data.items()))

    async def read_batch(self, items: list[str], **kw) -> dict:
        """Name -> pandas frame; None for what can't be read."""
        got = await asyncio.gather(*(self.read(item, **kw) for item in items), return_exceptions=True)
        return {item: None if isinstance(x, Exception) else x for item, x in zip(items, got)}

    async def parallel_append(self, item: str, dataframes: list, **kw) -> None:
        """Append several frames; the item's lock puts them one after another, so none is lost."""
        await asyncio.gather(*(self.append(item, df, **kw) for df in dataframes))


class AsyncStore(_Threads):
    def __init__(self, of: Store | str, executor: concurrent.futures.Executor | None = None):
        super().__init__(executor)
        self.store = store(of) if isinstance(of, str) else of

    def collection(self, name: str, **kw) -> AsyncCollection:
        return AsyncCollection(self.store.collection(name, **kw), self.executor)

    async def list_collections(self) -> list[str]:
        return await self._run(self.store.list_collections)


class AsyncContextManager:
    def __init__(self, of):
        self.of, self.made = of, None

    async def __aenter__(self):
        self.made = AsyncCollection(self.of) if isinstance(self.of, Collection) else AsyncStore(self.of)
        return self.made

    async def __aexit__(self, *_) -> None:
        self.made.close()


def async_store(of) -> AsyncContextManager:
    """``async with async_store(x) as a:`` for a store, its name, or a collection."""
    return AsyncContextManager(of)
