"""The dataframe store: stores, collections, items and what belongs to them."""

from ..functions.keys import align_timezones, deduplicate
from ..sources.text import read_csv
from .aio import AsyncCollection, AsyncStore, async_store
from .catalog import (
    Collection,
    Item,
    Store,
    delete_store,
    delete_stores,
    get_client,
    get_partition_size,
    get_path,
    list_stores,
    make_path,
    path_exists,
    set_client,
    set_partition_size,
    set_path,
    store,
    subdirs,
)
from .errors import (
    CollectionExistsError,
    CollectionNotFoundError,
    ConfigurationError,
    DataIntegrityError,
    ItemExistsError,
    ItemNotFoundError,
    SchemaError,
    SnapshotNotFoundError,
    StorageError,
    TidemarkError,
    TransactionError,
    ValidationError,
)
from .evolution import EvolutionStrategy, Schema, SchemaChange, SchemaEvolution, add_calculated_column, convert_index_to_datetime, rename_columns
from .frames import Frames
from .layout import calculate_optimal_partitions, optimize_time_series_partitions, rebalance_partitions
from .log import get_logger, setup_logging
from .memory import MemoryMonitor, check_memory_usage, estimate_dataframe_memory, get_memory_info, memory_efficient_read, optimize_dataframe_memory, read_in_chunks
from .transactions import BatchTransaction, CollectionLock, Transaction, batch_transaction, transaction, with_lock
from .validation import (
    ColumnExistsRule,
    CustomRule,
    DataTypeRule,
    DataValidator,
    NoNullRule,
    RangeRule,
    UniqueRule,
    ValidationRule,
    create_financial_validator,
    create_timeseries_validator,
    create_validator,
    with_validation,
)

__all__ = [name for name in dir() if not name.startswith("_")]
