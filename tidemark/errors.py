"""One error per family."""


class TidemarkError(Exception):
    """Base of all errors raised on purpose."""


class ContractError(TidemarkError):
    """A table breaks its contract."""


class FutureDataError(TidemarkError):
    """A read would see past its cutoff."""


class FactorError(TidemarkError):
    """A factor is ill-defined or breaks its output contract."""


class CacheMissError(TidemarkError):
    """A required cache entry is missing."""


class StrategyError(TidemarkError):
    """A strategy's decision is invalid."""


class ConstraintError(TidemarkError):
    """A portfolio cannot meet its constraints."""


class BacktestError(TidemarkError):
    """A simulation cannot go on."""


class AccountingError(TidemarkError):
    """Ledgers do not reconcile."""


class ExperimentError(TidemarkError):
    """A run or trial record is inconsistent."""


class SchemaVersionError(TidemarkError):
    """A snapshot has an unknown schema version."""


class PluginError(TidemarkError):
    """An extension cannot be loaded."""
