"""Errors of the engine: one root, one class for each family of operators."""


class TerracellError(Exception):
    """Root of all errors that the engine raises on purpose."""


def _family(name: str, doc: str, *bases: type) -> type:
    return type(name, bases or (TerracellError,), {"__doc__": doc, "__module__": __name__})


StorageError = _family("StorageError", "Reading or writing failed.")
ValidationError = _family("ValidationError", "An argument or a schema is not usable.")
RegistrationError = _family("RegistrationError", "Clouds can't be aligned.")
SegmentationError = _family("SegmentationError", "Ground, clusters, trees or wires can't be found.")
MeshError = _family("MeshError", "A surface can't be built.")
FeatureError = _family("FeatureError", "Features or primitives can't be computed.")
PlatformError = _family("PlatformError", "The operation doesn't suit the acquisition platform.")
CrsError = _family("CrsError", "Coordinates can't be transformed.")
ChangeError = _family("ChangeError", "Epochs can't be compared.")
RasterError = _family("RasterError", "A raster can't be made.")
ExportError = _family("ExportError", "An export can't be written.")
ModelError = _family("ModelError", "A model can't be loaded or run.")
CodecError = _family("CodecError", "An optional codec is not installed.", TerracellError, ImportError)
NetworkError = _family("NetworkError", "A remote source can't be reached.")
KernelError = _family("KernelError", "A native kernel failed.")
