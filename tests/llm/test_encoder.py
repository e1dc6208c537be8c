"""What the encoder refuses."""

import pytest

from foliant.llm import spm
from foliant.llm.queries import vocabulary


def test_models_without_byte_fallback_are_refused(tmp_path):
    """Before a text is read: their unknown runs are one id of any length, which the encoder doesn't write."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(vocabulary("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.byte_fallback = False
    path = tmp_path / "plain.model"
    path.write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="byte fallback"):
        spm.Encoder(str(path))
