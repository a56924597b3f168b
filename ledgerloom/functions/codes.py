"""Error and status codes, flags, signals, outcomes and field bits of the store's interface."""

# Item error codes.
ERRORS = {
    "OK": 0, "TX_NOT_FOUND": 1, "UTXO_HASH_MISMATCH": 2, "ALREADY_SPENT": 3, "ALREADY_FROZEN": 4, "UTXO_NOT_FROZEN": 5,
    "INVALID_SPEND": 6, "FROZEN": 7, "CONFLICTING": 8, "LOCKED": 9, "COINBASE_IMMATURE": 10, "VOUT_OUT_OF_RANGE": 11,
    "ALREADY_EXISTS": 12, "FROZEN_UNTIL": 13, "REDIRECT": 14, "NO_QUORUM": 15, "STREAM_NOT_FOUND": 16, "BLOB_NOT_FOUND": 17,
    "STREAM_OFFSET_MISMATCH": 18, "MIGRATION_IN_PROGRESS": 19, "REPLICATION_FAILED": 20, "MIGRATION_MANIFEST_REQUIRED": 21,
    "MIGRATION_MANIFEST_MISMATCH": 22, "TOPOLOGY_PERSIST_FAILED": 23, "STALE_EPOCH": 24, "CLUSTER_NOT_READY": 25,
    "INDEX_DEGRADED": 26, "CLUSTER_AUTH_FAILED": 27, "PAYLOAD_MALFORMED": 28, "OPCODE_UNSUPPORTED": 29, "STORAGE_IO": 30,
    "RATE_LIMITED": 31, "NOT_CLUSTERED": 32, "INVARIANT_VIOLATION": 33, "STREAM_INVARIANT": 34, "DELETED_CHILDREN": 35,
    "NOT_DUE": 36, "MIGRATION_TARGET_NOT_READY": 37, "RESPONSE_TOO_LARGE": 38, "STALE_REGIME": 39, "INTERNAL": 255,
}

# Batch status.
BATCH_OK, BATCH_ERROR, BATCH_NOT_FOUND, BATCH_REDIRECT, BATCH_PARTIAL = 0, 1, 2, 3, 4

# Slot status.
UNSPENT, SPENT, PRUNED, FROZEN = 0, 1, 2, 255

# Record flags, then the flags of a create request.
IS_COINBASE, CONFLICTING, LOCKED, EXTERNAL, LAST_SPENT_ALL, HAS_PRESERVE_UNTIL, REASSIGNED = 1, 2, 4, 8, 16, 32, 64
CREATE_LOCKED, CREATE_CONFLICTING, CREATE_FROZEN, CREATE_EXTERNAL, CREATE_REASSIGNED = 1, 2, 4, 8, 16

# Signals of the lifecycle evaluation.
SIGNAL_NONE, SIGNAL_ALL_SPENT, SIGNAL_NOT_ALL_SPENT, SIGNAL_DAH_SET, SIGNAL_DAH_UNSET, SIGNAL_PRESERVE = 0, 1, 2, 3, 4, 5

# Outcome classes of operations, in order.
OUTCOMES = ("ok", "idempotent", "err_not_found", "err_conflicting", "err_frozen", "err_storage", "redirect", "other")

# Operations that are counted by outcome.
OPERATIONS = (
    "spend", "unspend", "set_mined", "create", "freeze", "unfreeze", "reassign", "set_conflicting", "set_locked",
    "preserve_until", "delete", "mark_longest_chain", "get", "get_spend", "query_old_unmined", "process_expired",
)

# A node's counters and the groups of its latencies.
COUNTERS = (
    "spends_attempted", "spends_succeeded", "spends_idempotent", "spends_failed", "unspends_attempted", "unspends_succeeded",
    "unspends_noop", "unspends_failed", "spend_multi_batches", "creates_attempted", "creates_succeeded", "set_mined_attempted",
    "set_mined_succeeded", "gets_attempted", "gets_succeeded", "freezes_attempted", "deletes_attempted",
)
LATENCIES = ("spend", "spend_multi", "unspend", "lock_wait")

# Bits of a read's field mask. Metadata come first, then sections of variable size.
FIELDS = (
    "tx_version", "locktime", "fee", "size_in_bytes", "extended_size", "flags", "spending_height", "created_at", "spent_utxos",
    "pruned_utxos", "utxo_count", "generation", "updated_at", "unmined_since", "delete_at_height", "preserve_until",
    "external_ref", "reassignment_count", "block_entry_count", "utxo_slots", "cold_data", "block_entries",
    "conflicting_children", "raw_metadata", "cold_data_outputs", "block_entries_all",
)
ALL_METADATA, ALL_FIELDS = 0x7FFFF, 0x7FFFFF

U32_MAX = 4294967295
SHARDS = 4096
MAX_BLOCK_ENTRIES = 255
MAX_CHILDREN = 255
MAX_BATCH = 8192
MAX_HASHES, MAX_PARENTS, MAX_COLD_BYTES = 131072, 65536, 4 << 20
MAX_FRAME_BYTES, FRAME_OVERHEAD, ITEM_OVERHEAD = 16 << 20, 13, 5
HEADER_BYTES, SLOT_BYTES = 320, 73
RETENTION, UNMINED_RETENTION, PARENT_RETENTION = 288, 144, 1440
