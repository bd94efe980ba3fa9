"""What the engine raises."""


class EngineError(Exception):
    pass


class InvalidConfigError(EngineError):
    pass


class MappingValidationError(EngineError):
    pass
